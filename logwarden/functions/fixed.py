"""Word lists, patterns and lookup tables.

Everything in this module is data that must hold exactly these values for
results to be right; there is no logic here.
"""

# --- fixed values: six attack classes, searched case-insensitively in "path agent"
ATTACK_CLASSES = {
    "sql_injection": [
        r"union.*select", r"select.*from", r"insert.*into", r"delete.*from", r"drop.*table",
        r"\'.*or.*\'", r"--", r";.*exec", r"xp_cmdshell",
    ],
    "xss": [r"<script", r"javascript:", r"onerror=", r"onload=", r"<iframe", r"eval\(", r"alert\("],
    "path_traversal": [
        r"\.\./\.\./\.\./etc/passwd", r"\.\./\.\./windows", r"\.\./", r"%2e%2e", r"/etc/passwd", r"/etc/shadow",
    ],
    "command_injection": [r";.*ls", r"\|.*cat", r"`.*`", r"\$\(.*\)", r"&&.*rm", r"nc.*-e", r"bash.*-i"],
    "scanner": [r"nikto", r"sqlmap", r"nmap", r"masscan", r"acunetix", r"nessus", r"burp", r"metasploit"],
    "exploit": [r"shell\.php", r"c99\.php", r"r57\.php", r"cmd\.exe", r"eval-stdin\.php", r"\.git/config"],
}

# --- fixed values: request signatures, first match wins
SQLI_SIGNATURES = [
    r"(\%27)|(\')|(\-\-)|(\%23)|(#)",
    r"((\%3D)|(=))[^\n]*((\%27)|(\')|(\-\-)|(\%3B)|(;))",
    r"\w*((\%27)|(\'))((\%6F)|o|(\%4F))((\%72)|r|(\%52))",
    r"((\%27)|(\'))union",
    r"exec(\s|\+)+(s|x)p\w+",
    r"UNION.*SELECT",
    r"SELECT.*FROM.*WHERE",
    r"INSERT.*INTO.*VALUES",
    r"DELETE.*FROM.*WHERE",
    r"DROP.*TABLE",
    r"UPDATE.*SET.*WHERE",
]
XSS_SIGNATURES = [
    r"<script[^>]*>.*?</script>", r"javascript:", r"onerror\s*=", r"onload\s*=", r"onclick\s*=",
    r"<iframe", r"<object", r"<embed", r"eval\(", r"expression\(",
]
TRAVERSAL_SIGNATURES = [
    r"\.\./", r"\.\.\%2[fF]", r"%2e%2e/", r"\.\.\\", r"/etc/passwd", r"/etc/shadow", r"C:\\Windows", r"C:\\boot\.ini",
]
COMMAND_SIGNATURES = [
    r";.*?(ls|cat|wget|curl|nc|netcat|bash|sh)",
    r"\|.*?(ls|cat|wget|curl|nc|netcat|bash|sh)",
    r"&&.*?(ls|cat|wget|curl|nc|netcat|bash|sh)",
    r"`.*?`",
    r"\$\(.*?\)",
]
SIGNATURE_LABELS = {
    "sql_injection": "SQL Injection pattern detected: ",
    "xss": "XSS pattern detected: ",
    "path_traversal": "Path traversal detected: ",
    "command_injection": "Command injection detected: ",
}

# --- fixed values: agents
HACK_TOOLS = [
    "nikto", "sqlmap", "nmap", "masscan", "metasploit", "havij", "acunetix", "nessus", "openvas", "w3af",
    "dirbuster", "gobuster", "wpscan", "skipfish", "burp",
]
SUSPICIOUS_AGENTS = ["python-requests", "curl", "wget", "scrapy", "bot", "crawler", "spider", "scraper"]
TRUSTED_CRAWLERS = ["googlebot", "bingbot", "yandex", "baidu"]
BOT_PATTERNS = [
    "bot", "crawler", "spider", "scraper", "curl", "wget", "python-requests", "axios", "java",
    "go-http-client", "scrapy", "headless",
]
LISTED_FILES = [".xml", "sitemap", "robots.txt", ".json", "/api/"]
BOT_REASONS = {
    "agent": "Bot user agent detected: ", "rapid": "Rapid requests: ", "referrer": "High no-referrer ratio: ",
    "numbered": "Sequential path access: ", "one_agent": "Single user agent for multiple requests", "listed": "Accessed: ",
}
BOT_CLASSES = {
    "googlebot": "Search Engine (Google)",
    "bingbot": "Search Engine (Bing)",
    "yandex": "Search Engine (Yandex)",
    "duckduckbot": "Search Engine (DuckDuckGo)",
    "baiduspider": "Search Engine (Baidu)",
    "facebookexternalhit": "Social Media (Facebook)",
    "twitterbot": "Social Media (Twitter)",
    "linkedinbot": "Social Media (LinkedIn)",
}
SCRAPER_TOOLS = ["scrapy", "beautifulsoup", "selenium"]
HTTP_CLIENTS = ["curl", "wget", "python-requests", "axios"]
LEGITIMATE_BOTS = [
    "googlebot", "bingbot", "yandex", "duckduckbot", "baiduspider", "facebookexternalhit", "twitterbot",
    "linkedinbot", "slackbot", "telegrambot",
]
FEATURE_AGENTS = [
    "sqlmap", "nikto", "nmap", "scanner", "bot", "crawler", "python-requests", "curl", "wget", "masscan",
]
JAIL_AGENTS = r"(bot|crawler|spider|scraper|curl|wget|python-requests|axios|nikto|sqlmap|nmap)"
JAIL_IGNORE = r"(Googlebot|bingbot|YandexBot|Baiduspider)"
JAIL_METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "PATCH", "OPTIONS"]

# --- fixed values: request paths
SUSPICIOUS_PATHS = [
    r"/\.env", r"/admin", r"/wp-admin", r"/phpmyadmin", r"\.php$", r"/xmlrpc", r"/\.git", r"sql",
    r"union.*select", r"<script", r"javascript:",
]
PATH_CLASSES = [
    (r"/\.env", "env_file_access"),
    (r"/admin", "admin_scan"),
    (r"/wp-admin", "wordpress_scan"),
    (r"/phpmyadmin", "phpmyadmin_scan"),
    (r"\.php$", "php_file_scan"),
    (r"/xmlrpc", "xmlrpc_attack"),
    (r"sql|union.*select", "sql_injection"),
    (r"<script|javascript:", "xss_attempt"),
]
VULN_FAMILIES = {
    "wordpress_scan": ["/wp-admin", "/wp-login", "/wp-content"],
    "phpmyadmin_scan": ["/phpmyadmin", "/pma", "/phpMyAdmin"],
    "config_file_access": ["/.env", "/config.php", "/configuration.php", "/.git"],
    "admin_panel_scan": ["/admin", "/administrator", "/panel", "/cpanel"],
    "backup_file_scan": [".zip", ".tar", ".sql", ".backup", ".bak"],
}
SQLI_PATTERNS = [
    r"union.*select", r"select.*from", r"insert.*into", r"delete.*from", r"drop.*table",
    r"' or '1'='1", r"' or 1=1", r"admin'--", r"' union ",
]
XSS_PATTERNS = [r"<script", r"javascript:", r"onerror=", r"onload=", r"eval\(", r"alert\("]
HTTP_LOG_MARKS = ["../", "..\\", "<script", "UNION SELECT", "'; DROP", "/etc/passwd", "/bin/bash", "cmd.exe"]

# --- fixed values: network monitor
SUSPICIOUS_MIMES = ["application/x-executable", "application/x-dosexec", "application/x-sh", "text/x-shellscript"]
NOTICE_LADDER = [
    ("critical", ["Scan::Port_Scan", "Malware", "C&C"]),
    ("high", ["SSH::Password_Guessing", "Brute_Force"]),
    ("low", ["Weird"]),
]
FAILED_STATES = ["S0", "REJ", "RSTO", "RSTOS0"]
KNOWN_DOMAINS = [
    "google.com", "facebook.com", "amazon.com", "microsoft.com", "apple.com", "netflix.com", "twitter.com",
    "linkedin.com", "github.com", "stackoverflow.com", "wikipedia.org", "reddit.com", "cloudflare.com",
    "akamai.com", "googleapis.com", "gstatic.com", "azure.com", "amazonaws.com",
]
COMMON_ISSUERS = ["Let's Encrypt", "DigiCert", "GeoTrust", "Comodo", "Cloudflare"]
WEAK_TLS = r"SSLv2|SSLv3|TLSv1\.?0|TLSv1\.?1"

# --- fixed values: severity and scores
SEVERITIES = ["low", "medium", "high", "critical"]
SEVERITY_SCORES = {"critical": 50, "high": 30, "medium": 10, "low": 5}
EVENT_POINTS = [("brute_force", 10), ("injection", 15), ("flooding", 8), ("scan", 5), ("bot", 3)]
EVENT_SEVERITY_POINTS = {"critical": 20, "high": 10, "medium": 5}
HIGH_RISK_COUNTRIES = ["CN", "RU", "KP", "IR", "BY", "VN"]
MONITOR_TYPES = ["port_scan", "dns_tunnel", "beaconing", "dga", "ssl"]
SUMMARY_ML_TYPES = ["http_attack", "suspicious_traffic", "ml_detection"]
SUMMARY_MONITOR_TYPES = ["port_scan", "dns_tunneling", "beaconing", "dga_domain", "ssl_self_signed"]
LABEL_TYPES = ["brute_force", "port_scan", "sql_injection", "ddos", "malicious_traffic"]
LABEL_VECTORS = ["brute_force", "port_scan", "sql_injection", "ddos"]
EVENT_CHARS = "<>\"';|&"
BEHAVIOUR_CHARS = "<>\"';|&$`"

# --- fixed values: score ladder (lower bound, action, text, description, colour, priority)
ACTIONS = [
    (80, "BLOCK_IMMEDIATE", "🚫 BLOQUEAR INMEDIATAMENTE",
     "Amenaza crítica confirmada - Acción inmediata requerida", "red", "critical"),
    (60, "BLOCK_DELAYED", "⏸️ BLOQUEAR (24h gracia)",
     "Alta probabilidad de amenaza - Bloqueo recomendado", "orange", "high"),
    (40, "THROTTLE", "⚠️ LIMITAR TASA",
     "Comportamiento sospechoso - Aplicar rate limiting", "yellow", "medium"),
    (20, "MONITOR", "👁️ MONITOREAR",
     "Actividad anómala detectada - Monitoreo cercano", "blue", "low"),
    (None, "ALLOW", "✅ PERMITIR", "Riesgo bajo - No se requiere acción", "green", "info"),
]

# --- fixed values: geography and address owners
PRIVATE_PREFIXES = ["127.", "10.", "172.16.", "192.168.", "::1", "fe80:", "fc00:"]
BACKFILL_PRIVATE_PREFIXES = ["192.168", "10.", "172."]
VPN_WORDS = ["vpn", "proxy", "tor", "relay", "exit", "hosting", "datacenter", "cloud"]
CLOUD_WORDS = [
    "amazon", "aws", "microsoft", "azure", "google", "digitalocean", "linode", "ovh", "hetzner", "vultr",
    "rackspace", "cloudflare",
]

# --- fixed values: ports
PORT_NAMES = {
    20: "FTP Data", 21: "FTP Control", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP", 110: "POP3",
    143: "IMAP", 443: "HTTPS", 465: "SMTPS", 587: "SMTP (Submission)", 993: "IMAPS", 995: "POP3S", 3306: "MySQL",
    5432: "PostgreSQL", 6379: "Redis", 8000: "HTTP Alt", 8080: "HTTP Proxy", 8069: "Odoo", 8443: "HTTPS Alt",
    27017: "MongoDB",
}
INSECURE_PORTS = [23, 21, 20, 3389, 5900]
DATABASE_PORTS = [3306, 5432, 27017, 6379]

# --- fixed values: block policies
POLICIES = {
    "default": dict(min_ml_confidence=90.0, min_threat_score=80.0, min_severity="high", min_events=5,
                    require_multiple_sources=True, default_block_duration=24, permanent_block=False,
                    whitelist_enabled=True, exclude_internal_ips=True),
    "aggressive": dict(min_ml_confidence=80.0, min_threat_score=60.0, min_severity="medium", min_events=3,
                       require_multiple_sources=False, default_block_duration=12, permanent_block=False,
                       whitelist_enabled=True, exclude_internal_ips=True),
}
RULE_TYPES = ["ml_prediction", "zeek_detection", "fail2ban_ban"]
ALERT_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

# --- fixed values: decision texts
GEO_REASONS = {
    "off": "Filtrado geográfico desactivado",
    "private": "IP privada/local",
    "unknown_blocked": "País desconocido (bloqueado por configuración)",
    "unknown_allowed": "País desconocido (permitido por configuración)",
    "allowed": "País permitido: ",
    "not_allowed": "País no permitido: ",
    "blocked": "País bloqueado: ",
}
BLOCK_REASONS = {
    "blocked": "IP ya bloqueada",
    "whitelist": "IP en whitelist",
    "disabled": "Auto-bloqueo deshabilitado",
    "internal": "IP interna excluida",
}

# --- fixed values: names of score factors and texts of explanations
FACTORS = {
    "ml": "Confianza ML", "speed": "Velocidad de Ataque", "vectors": "Múltiples Vectores de Ataque",
    "errors": "Alto Ratio de Errores", "bot": "Patrón de Bot Automatizado", "country": "País de Alto Riesgo",
    "escalation": "Escalamiento de Ataque", "chars": "Caracteres Maliciosos", "paths": "URLs Anormalmente Largas",
}
FEATURE_TEXTS = {
    "severity_level": "Nivel de severidad: {v}", "suspicious_chars": "{v} caracteres sospechosos",
    "path_length": "Longitud de URL: {v} caracteres", "hour": "Hora del día: {v}:00", "ua_length": "User-Agent: {v} caracteres",
}
FEATURE_FLAGS = {
    "is_night": ("Horario nocturno", "Horario diurno"), "is_weekend": ("Fin de semana", "Día laborable"),
    "is_bot": ("Bot detectado", "No es bot"), "has_query_string": ("Tiene query string", "Sin query string"),
}
