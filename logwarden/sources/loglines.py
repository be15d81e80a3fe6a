"""Text logs to typed rows: web access, web error, sshd and ban lines.

Every parser takes a DataFrame with a ``line`` column (other columns are kept)
so that it serves batch files, tables and streams alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text
from ..functions.times import from_access_stamp, from_syslog_stamp
from ..operators.intervals import trailing_count

# --- fixed values: line formats
ACCESS_LINE = r'^([\d.]+) - - \[(.*?)\] "(\w+) (.*?) HTTP/[\d.]+" (\d+) (\d+) "(.*?)" "(.*?)"'
SYSLOG_STAMP = r"(\w{3}\s+\d{1,2} \d{2}:\d{2}:\d{2})"
LOGIN_FAILED = SYSLOG_STAMP + r".*?Failed password for (?:invalid user )?(\S+) from ([\d.]+)"
LOGIN_ACCEPTED = SYSLOG_STAMP + r".*?Accepted (\w+) for (\S+) from ([\d.]+)"
LOGIN_INVALID = SYSLOG_STAMP + r".*?Invalid user (\S+) from ([\d.]+)"
BAN = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}).*?\[([\w-]+)\] Ban ([\d.]+)"
UNBAN = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}).*?\[([\w-]+)\] Unban ([\d.]+)"
FOUND = r"\[([\w-]+)\] Found ([\d.]+)"


def group(pattern: str, n: int, of: str = "line") -> Column:
    """Regex group or null."""
    return F.nullif(F.regexp_extract(F.col(of), pattern, n), F.lit(""))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log files as lines with their file; undecodable bytes are replaced by the reader."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def tail_lines(lines: DataFrame, order: str, limit: int = 1000) -> DataFrame:
    """The last ``limit`` lines by an ordering column."""
    return lines.orderBy(F.col(order).desc()).limit(limit)


def log_manifest(
    spark: SparkSession, path: str, glob: str = "*.log*", keep: str = r"\.log(\.[1-5])?$"
) -> DataFrame:
    """Base and rotated (.1 to .5) log files with size and time; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    ).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.filter(F.col("path").rlike(keep)).withColumn("rotation", F.regexp_extract("path", r"\.log(\.[1-5])$", 1))


def parse_access(lines: DataFrame) -> DataFrame:
    """Combined access format anchored at the line start; other lines are dropped."""
    names = ["ip", "stamp", "method", "path", "status", "size", "referrer", "user_agent"]
    keep = [c for c in lines.columns if c != "line"]
    rows = split_groups(lines, ACCESS_LINE, len(names))
    return (
        rows.select(*keep, *[F.col("_parts")[i].alias(n) for i, n in enumerate(names)])
        .withColumn("status", F.col("status").try_cast("int"))
        .withColumn("size", F.col("size").try_cast("bigint"))
        .withColumn("timestamp", from_access_stamp(F.col("stamp")))
    )


def split_groups(lines: DataFrame, pattern: str, n: int) -> DataFrame:
    """Lines matching an anchored pattern, its groups in ``_parts``; one regex pass per line.

    Groups are cut at line breaks, which neither a line nor ``.`` can contain.
    """
    marked = F.regexp_replace("line", pattern + "(?s:.*)$", "\n".join(f"${i + 1}" for i in range(n)))
    return text.once(lines, "_parts", F.split(marked, "\n")).filter(F.size("_parts") == n)


def parse_error(lines: DataFrame) -> DataFrame:
    keep = [c for c in lines.columns if c != "line"]
    return lines.select(*keep, F.trim("line").alias("raw"), F.lit("nginx_error").alias("type"))


def parse_sshd(lines: DataFrame) -> DataFrame:
    """sshd lines with status, user, address and raw time; the first matching kind wins."""
    line = F.col("line")
    accepted = line.contains("Accepted password") | line.contains("Accepted publickey")
    status = text.first_case(
        [(line.contains("Failed password"), "failed"), (accepted, "success"), (line.contains("Invalid user"), "invalid_user")]
    )
    named, invalid = r"for (\w+) from ([\d.]+)", r"Invalid user (\w+) from ([\d.]+)"

    def pair(pattern: str) -> Column:
        return F.split(F.regexp_replace(line, "(?s:^.*?)" + pattern + "(?s:.*)$", "$1\n$2"), "\n")

    known = F.col("status").isin("failed", "success")
    rows = lines.filter(F.lower(line).contains("sshd")).withColumn("status", status)
    rows = text.once(rows, "_pair", F.when(known, pair(named)).when(F.col("status") == "invalid_user", pair(invalid)))

    def part(n: int) -> Column:
        return F.when(F.size("_pair") == 2, F.nullif(F.get("_pair", F.lit(n)), F.lit("")))

    return rows.withColumn("user", part(0)).withColumn("ip", part(1)).withColumn("stamp", group(SYSLOG_STAMP, 1)).drop("_pair")


def access_events(requests: DataFrame) -> DataFrame:
    """Security events of web requests that carry an attack or fail with status >= 400."""
    types = text.attack_types(F.col("path"), F.col("user_agent"))
    status, attacked = F.col("status"), F.size("attack_types") > 0
    rows = text.once(requests, "attack_types", types).filter(attacked | (status >= 400))
    return rows.withColumn("severity", text.attack_severity(status, F.col("attack_types"))).select(
        *[c for c in ("id",) if c in requests.columns],
        "timestamp",
        text.first_case([(attacked, "http_attack"), (status == 404, "http_404")], "http_error").alias("event_type"),
        "severity",
        F.col("ip").alias("source_ip"),
        F.lit("http").alias("protocol"),
        F.substring("path", 1, 500).alias("request_path"),
        F.substring("user_agent", 1, 500).alias("user_agent"),
        text.first_case([(attacked, F.array_join("attack_types", ",")), (status == 404, "scan")], "error").alias("attack_vector"),
        F.to_json(F.struct("method", "status", "attack_types")).alias("details"),
    )


def replaced(lines: DataFrame, kinds: list[tuple[str, str, str]]) -> Column:
    """The line rewritten by the first kind (mark, pattern, layout) that fits it, else the line.

    A cheap substring test guards each regex. A rewritten line starts with its
    layout and holds line breaks, so no later pattern can fit it.
    """
    out = F.col("line")
    for mark, pattern, layout in kinds:
        out = F.when(F.col("line").contains(mark), F.regexp_replace(out, "^.*?" + pattern + "(?s:.*)$", layout)).otherwise(out)
    return out


def by_kind(lines: DataFrame, kinds: list[tuple[str, str, str]], n: int) -> DataFrame:
    """Lines of a known kind with their parts in ``_parts``, each line read once."""
    return text.once(lines, "_parts", F.split(replaced(lines, kinds), "\n")).filter(F.size("_parts") == n)


LOGIN_KINDS = [
    ("Failed password for ", LOGIN_FAILED, "failed\n$1\n$2\n$3\n"),
    ("Accepted ", LOGIN_ACCEPTED, "accepted\n$1\n$3\n$4\n$2"),
    ("Invalid user ", LOGIN_INVALID, "invalid\n$1\n$2\n$3\n"),
]
BAN_KINDS = [
    ("] Ban ", BAN, "ban\n$1\n$2\n$3"),
    ("] Unban ", UNBAN, "unban\n$1\n$2\n$3"),
    ("] Found ", FOUND, "found\n\n$1\n$2"),
]


def login_attempts(lines: DataFrame, year: int) -> DataFrame:
    """Failed, accepted and invalid-user attempts with event time, user and method."""
    keep = [c for c in lines.columns if c != "line"]
    part = F.col("_parts")
    return by_kind(lines.filter(F.col("line").contains("sshd")), LOGIN_KINDS, 5).select(
        *keep,
        from_syslog_stamp(part[1], year).alias("timestamp"),
        part[0].alias("kind"), part[2].alias("user"), part[3].alias("ip"), F.nullif(part[4], F.lit("")).alias("method"),
    )


def failures_10m(attempts: DataFrame) -> DataFrame:
    """Failed attempts with the address's failures of the last ten minutes, itself included."""
    return with_failures(attempts.filter(F.col("kind") == "failed"))


def with_failures(attempts: DataFrame) -> DataFrame:
    """All attempts with the failures of the address in the ten minutes up to each."""
    return trailing_count(attempts, ["ip"], "timestamp", 600_000_000, "failures", F.col("kind") == "failed")


def login_events(lines: DataFrame, year: int) -> DataFrame:
    """Security events of sshd lines; five failures in ten minutes make a brute force."""
    attempts = with_failures(login_attempts(lines, year))
    failed, ok, brute = F.col("kind") == "failed", F.col("kind") == "accepted", F.col("failures") >= 5
    who = F.concat(F.lit("username: "), F.col("user"))

    def by_case(on_brute, on_failed, on_accepted, on_invalid) -> Column:
        return text.first_case([(failed & brute, on_brute), (failed, on_failed), (ok, on_accepted)], on_invalid)

    def user_text(before: str, *after) -> Column:
        return F.concat(F.lit(before + " '"), F.col("user"), F.lit("'"), *after)

    tried = user_text("Failed SSH login for user", F.lit(" (attempt "), F.col("failures").cast("string"), F.lit(")"))
    return attempts.select(
        *[c for c in ("id", "timestamp") if c in attempts.columns],
        by_case("ssh_brute_force", "ssh_failed_login", "ssh_successful_login", "ssh_invalid_user").alias("event_type"),
        text.first_case([(failed, text.failure_severity(F.col("failures"))), (ok, "low")], "medium").alias("severity"),
        F.col("ip").alias("source_ip"),
        F.lit("ssh").alias("protocol"),
        by_case("brute_force", "auth_failure", "auth_success", "scan").alias("attack_vector"),
        text.first_case(
            [(failed, tried), (ok, user_text("Successful SSH login for user", F.lit(" via "), F.col("method")))],
            user_text("SSH attempt with invalid user"),
        ).alias("description"),
        F.when(ok, F.concat(who, F.lit(", method: "), F.col("method"))).otherwise(who).alias("details"),
    )


def parse_bans(lines: DataFrame) -> DataFrame:
    """Ban lines -> time, jail, address; Unban and Found lines keep only their kind."""
    keep = [c for c in lines.columns if c != "line"]
    part = F.col("_parts")
    ban = part[0] == "ban"
    return by_kind(lines, BAN_KINDS, 4).select(
        *keep,
        part[0].alias("kind"),
        F.when(ban, F.try_to_timestamp(part[1], F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")).alias("timestamp"),
        F.when(ban, part[2]).alias("jail"),
        F.when(ban, part[3]).alias("ip"),
    )


def ban_events(lines: DataFrame) -> DataFrame:
    bans = parse_bans(lines).filter(F.col("kind") == "ban")
    high = F.col("jail").contains("sshd") | F.col("jail").contains("recidive")
    return bans.select(
        *[c for c in ("id",) if c in lines.columns],
        "timestamp",
        F.lit("fail2ban_ban").alias("event_type"),
        F.when(high, "high").otherwise("medium").alias("severity"),
        F.col("ip").alias("source_ip"),
        F.lit("fail2ban").alias("protocol"),
        F.col("jail").alias("attack_vector"),
        F.concat(F.lit("IP banned by Fail2ban jail: "), F.col("jail")).alias("details"),
    )


def recent_bans(lines: DataFrame, limit: int = 10, tie: str = "id") -> DataFrame:
    bans = parse_bans(lines).filter(F.col("kind") == "ban")
    return bans.orderBy(F.desc("timestamp"), F.col(tie).desc()).limit(limit)


def ingest_summary(access: DataFrame, auth: DataFrame, bans: DataFrame, year: int) -> DataFrame:
    """Per log kind: total lines, events created, lines skipped.

    Ban logs count only Unban and Found lines as skipped, auth logs none.
    """
    request = text.once(access, "_parts", F.split(F.regexp_replace("line", ACCESS_LINE + "(?s:.*)$", "$4\n$5\n$8"), "\n"))
    path, status, agent = (F.get("_parts", F.lit(i)) for i in range(3))
    wanted = (F.size(text.attack_types(path, agent)) > 0) | (status.try_cast("int") >= 400)
    web = text.once(request, "made", F.coalesce((F.size("_parts") == 3) & wanted, F.lit(False)))
    blank = F.trim("line") == ""
    kept = text.once(bans, "_parts", F.split(replaced(bans, BAN_KINDS), "\n"))
    kept = kept.withColumn("k", F.when(F.size("_parts") == 4, F.get("_parts", F.lit(0))))
    logins = text.once(auth, "_parts", F.when(F.col("line").contains("sshd"), F.split(replaced(auth, LOGIN_KINDS), "\n")))
    login = F.coalesce(F.size("_parts") == 5, F.lit(False))

    def sums(df, source, made, skipped):
        return df.agg(
            F.lit(source).alias("source"), F.count("*").alias("total_lines"), F.count_if(made).alias("created"),
            F.count_if(skipped).alias("skipped"),
        )

    return (
        sums(web, "nginx_access", F.col("made"), ~F.col("made") & ~blank)
        .unionByName(sums(logins, "ssh_auth", login, F.lit(False)))
        .unionByName(sums(kept, "fail2ban", F.coalesce(F.col("k") == "ban", F.lit(False)), F.col("k").isin("unban", "found")))
    )
