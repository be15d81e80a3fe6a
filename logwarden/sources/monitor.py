"""Network-monitor logs: header-driven TSV or one JSON object per line.

A log kind is a list of fields; both formats become text columns of those
names, and one projection per kind gives the typed table.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text
from ..functions.times import from_epoch_text
from ..session import shared_table

#: Headers, one row of a path and the places of at most 18 fields each, that may be sent to all executors.
FEW_FILES = 20_000

# --- fixed values: fields read per log kind
FIELDS = {
    "conn": ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration", "orig_bytes",
             "resp_bytes", "conn_state", "orig_pkts", "resp_pkts", "local_orig", "local_resp", "history"],
    "dns": ["ts", "uid", "id.orig_h", "id.resp_h", "query", "qtype_name", "qclass_name", "rcode", "rcode_name", "answers",
            "TTLs", "AA", "TC", "RD", "RA"],
    "ssl": ["ts", "uid", "id.orig_h", "id.resp_h", "id.resp_p", "version", "cipher", "curve", "server_name", "subject", "issuer",
            "validation_status", "cert_chain_fuids", "client_cert_chain_fuids", "not_valid_before", "not_valid_after", "ja3", "ja3s"],
    "http": ["ts", "uid", "id.orig_h", "id.resp_h", "id.resp_p", "method", "host", "uri", "referrer", "user_agent", "status_code",
             "status_msg", "request_body_len", "response_body_len", "resp_mime_types", "tags"],
    "files": ["ts", "fuid", "conn_uids", "tx_hosts", "rx_hosts", "filename", "mime_type", "total_bytes", "seen_bytes",
              "missing_bytes", "md5", "sha1", "sha256", "source"],
    "notice": ["ts", "uid", "id.orig_h", "src", "id.resp_h", "dst", "id.resp_p", "p", "note", "msg", "sub", "proto", "actions",
               "file_mime_type", "file_desc", "suppress_for"],
}


#: White space around a line that does not belong to it.
AROUND = " \t\n\r\x0b\x0c"


def stripped(line: Column) -> Column:
    """``line`` without white space around it; only a line that has some at an end is gone through."""
    around = reduce(or_, [line.startswith(c) | line.endswith(c) for c in AROUND])
    return F.when(around, F.btrim(line, F.lit(AROUND))).otherwise(line)


def tsv_headers(lines: DataFrame, fields: list[str]) -> DataFrame:
    """Per file: its separator and the position of every wanted field."""
    marks = lines.filter(F.col("line").startswith("#separator") | F.col("line").startswith("#fields"))
    code = F.regexp_extract("line", r"^#separator\s+\\x([0-9A-Fa-f]{2})", 1)
    plain = F.regexp_extract("line", r"^#separator\s+(\S+)", 1)
    sep = F.when(code != "", F.decode(F.unhex(code), "UTF-8")).when(plain != "", plain)
    per_file = marks.groupBy("file").agg(
        F.coalesce(F.max(F.when(F.col("line").startswith("#separator"), sep)), F.lit("\t")).alias("sep"),
        F.max(F.when(F.col("line").startswith("#fields"), stripped(F.col("line")))).alias("head"),
    )
    return positions(per_file.filter(F.col("head").isNotNull()), fields).select(F.col("file").alias("_file"), "quoted", "at")


def positions(headed: DataFrame, fields: list[str]) -> DataFrame:
    """Adds ``quoted`` and ``at`` to rows with ``sep`` and ``head``: how to split, and where each wanted field stands."""
    # one plain character is split without a regex; anything else is quoted
    plain_char = F.col("sep").rlike(r"^[\t ,;:\w]$")
    quoted = F.when(plain_char, F.col("sep")).otherwise(F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E")))
    named = headed.withColumn("quoted", quoted).withColumn("names", F.split(F.col("head"), F.col("quoted")))
    # the line starts with its own mark, so the first field is the second name; a missing one gives a negative position
    at = F.struct(*[(F.array_position("names", f) - 2).cast("int").alias(f"f{i}") for i, f in enumerate(fields)])
    return named.withColumn("at", at)


def few_headers(lines: DataFrame, fields: list[str], few: int = FEW_FILES) -> DataFrame:
    """The headers, found once and written; sent to all executors if they are at most ``few``, else joined as Spark sees fit."""
    heads = shared_table(tsv_headers(lines, fields), "log-headers")
    return F.broadcast(heads) if few and heads.count() <= few else heads


def parse_tsv(lines: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of files with a ``#fields`` line; ``-`` is null, ``(empty)`` is '', T and F are booleans.

    The header table has one row per file; up to ``FEW_FILES`` are sent out, so that no line moves.
    """
    heads = few_headers(lines, fields)
    data = lines.withColumn("line", stripped(F.col("line"))).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = text.once(data.join(heads, F.col("file") == F.col("_file")), "cells", tsv_cells())

    return rows.select("file", *[tsv_cell(i).alias(f) for i, f in enumerate(fields)])


def tsv_cells() -> Column:
    """Cells of a line with their special tokens resolved; done on the array to keep the projection short."""

    def resolved(raw: Column) -> Column:
        value = F.when(raw == "(empty)", "").when(raw == "T", "true").when(raw == "F", "false").otherwise(raw)
        return F.when(raw != "-", value)

    return F.transform(F.split(F.col("line"), F.col("quoted")), resolved)


def tsv_cell(i: int) -> Column:
    return F.get("cells", F.col(f"at.f{i}"))


def json_schema(fields: list[str]) -> str:
    return ", ".join(f"`{f}` string" for f in fields) + ", `_bad` string"


def parse_json(lines: DataFrame, fields: list[str]) -> DataFrame:
    """One object per line; blank, ``#`` and malformed lines are dropped."""
    rows = lines.filter((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    parsed = text.once(rows, "rec", F.from_json("line", json_schema(fields), {"columnNameOfCorruptRecord": "_bad"}))
    return parsed.filter(F.col("rec").isNotNull() & F.col("rec._bad").isNull()).select(
        "file", *[F.col(f"rec.`{f}`").alias(f) for f in fields]
    )


def parse_headed(lines: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of lines that carry their file's ``separator`` and ``fields``, TSV or JSON; nothing is joined, so a file may have any size."""
    data = lines.withColumn("line", stripped(F.col("line"))).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = positions(data.withColumnRenamed("separator", "sep").withColumnRenamed("fields", "head"), fields)
    return parsed_either(rows, fields)


def parse_auto(lines: DataFrame, fields: list[str], few: int = FEW_FILES) -> DataFrame:
    """TSV for files that name their fields, JSON for the others; the lines are read once for both.

    The files that name their fields are counted first, and up to ``few`` headers are sent out, so that no line moves.
    """
    heads = few_headers(lines, fields, few)
    data = lines.withColumn("line", stripped(F.col("line"))).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = data.join(heads, F.col("file") == F.col("_file"), "left")
    return parsed_either(rows, fields)


def parsed_either(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Wanted fields as text, of TSV rows where ``quoted`` is given and of JSON rows elsewhere."""
    tsv = F.col("quoted").isNotNull()
    rec = F.when(~tsv, F.from_json("line", json_schema(fields), {"columnNameOfCorruptRecord": "_bad"}))
    rows = text.once(rows, "read", F.struct(F.when(tsv, tsv_cells()).alias("cells"), rec.alias("rec"))).select("file", "at", "quoted", "read.*")
    good = tsv | (F.col("rec").isNotNull() & F.col("rec._bad").isNull())
    return rows.filter(good).select(
        "file", *[F.when(tsv, tsv_cell(i)).otherwise(F.col(f"rec.`{f}`")).alias(f) for i, f in enumerate(fields)]
    )


# ---------------------------------------------------------------- projections


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def whole(name: str, default: int | None = None) -> Column:
    value = col(name).try_cast("bigint")
    return value if default is None else F.coalesce(value, F.lit(default))


def flag(name: str) -> Column:
    return F.coalesce(col(name).try_cast("boolean"), F.lit(False))


def items(name: str) -> Column:
    """List field: a JSON array, or comma-separated text."""
    raw = col(name)
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw == "", F.array().cast("array<string>")).otherwise(
        F.split(raw, ",")
    )


def conn_table(r: DataFrame) -> DataFrame:
    return r.select(
        from_epoch_text(col("ts")).alias("timestamp"), "uid", col("id.orig_h").alias("source_ip"),
        whole("id.orig_p").cast("int").alias("source_port"), col("id.resp_h").alias("dest_ip"), whole("id.resp_p").cast("int").alias("dest_port"),
        col("proto").alias("protocol"), "service", col("duration").try_cast("double").alias("duration"),
        whole("orig_bytes", 0).alias("orig_bytes"), whole("resp_bytes", 0).alias("resp_bytes"), "conn_state",
        whole("orig_pkts", 0).alias("orig_pkts"), whole("resp_pkts", 0).alias("resp_pkts"),
        flag("local_orig").alias("local_orig"), flag("local_resp").alias("local_resp"), "history",
    )


def dns_table(r: DataFrame) -> DataFrame:
    out = r.select(
        from_epoch_text(col("ts")).alias("timestamp"), "uid", col("id.orig_h").alias("source_ip"), col("id.resp_h").alias("dest_ip"),
        "query", col("qtype_name").alias("query_type"), col("qclass_name").alias("query_class"), whole("rcode").cast("int").alias("rcode"),
        "rcode_name", items("answers").alias("answers"), items("TTLs").alias("ttls"),
        *[flag(f).alias(f) for f in ("AA", "TC", "RD", "RA")],
    )
    return text.once(out, "query_entropy", text.shannon_entropy(F.col("query")))


def ssl_table(r: DataFrame, as_of: Column) -> DataFrame:
    from ..operators.network import tls_flags

    return tls_flags(
        r.select(
            from_epoch_text(col("ts")).alias("timestamp"), "uid", col("id.orig_h").alias("source_ip"), col("id.resp_h").alias("dest_ip"),
            whole("id.resp_p").cast("int").alias("dest_port"), "version", "cipher", "curve", "server_name", "subject", "issuer", "validation_status",
            items("cert_chain_fuids").alias("cert_chain_fuids"), items("client_cert_chain_fuids").alias("client_cert_chain_fuids"),
            from_epoch_text(col("not_valid_before")).alias("not_valid_before"), from_epoch_text(col("not_valid_after")).alias("not_valid_after"),
            "ja3", "ja3s",
        ),
        as_of,
    )


def http_table(r: DataFrame) -> DataFrame:
    return r.select(
        from_epoch_text(col("ts")).alias("timestamp"), "uid", col("id.orig_h").alias("source_ip"), col("id.resp_h").alias("dest_ip"),
        whole("id.resp_p").cast("int").alias("dest_port"), "method", "host", "uri", "referrer", "user_agent",
        whole("status_code").cast("int").alias("status_code"), "status_msg", whole("request_body_len", 0).alias("request_body_len"),
        whole("response_body_len", 0).alias("response_body_len"), items("resp_mime_types").alias("resp_mime_types"), items("tags").alias("tags"),
        text.http_log_suspicious(col("uri"), col("user_agent")).alias("is_suspicious"),
    )


def files_table(r: DataFrame) -> DataFrame:
    return r.select(
        from_epoch_text(col("ts")).alias("timestamp"), "fuid", items("conn_uids").alias("conn_uids"),
        F.get(items("tx_hosts"), F.lit(0)).alias("source_ip"), F.get(items("rx_hosts"), F.lit(0)).alias("dest_ip"), "filename", "mime_type",
        whole("total_bytes").alias("total_bytes"), whole("seen_bytes").alias("seen_bytes"), whole("missing_bytes").alias("missing_bytes"),
        "md5", "sha1", "sha256", col("source").alias("source_protocol"),
        F.coalesce(col("mime_type").isin(fixed.SUSPICIOUS_MIMES), F.lit(False)).alias("is_suspicious"),
    )


def notice_table(r: DataFrame) -> DataFrame:
    def either(a: str, b: str) -> Column:
        return F.coalesce(F.nullif(col(a), F.lit("")), col(b))

    return r.select(
        from_epoch_text(col("ts")).alias("timestamp"), "uid", either("id.orig_h", "src").alias("source_ip"),
        either("id.resp_h", "dst").alias("dest_ip"), either("id.resp_p", "p").try_cast("int").alias("dest_port"), "note", "msg", "sub",
        col("proto").alias("protocol"), items("actions").alias("actions"), "file_mime_type", "file_desc",
        col("suppress_for").try_cast("double").alias("suppress_for"), text.notice_severity(col("note")).alias("severity"),
    )
