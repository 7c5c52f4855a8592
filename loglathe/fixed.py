"""Patterns, word lists, routing keys, defaults and thresholds.

FIXED VALUES.  Every literal in this file is part of the observable contract of
the log processing behaviour (a different pattern or word gives different
results), so they are stated here as plain text in their natural order.
Patterns are written in plain regex text; the flags each one needs are added
where it is applied (see ``functions.text``).
"""

# --- v2 dialect: patterns -------------------------------------------------
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PORT = r"\b(?::|port\s)(\d{1,5})\b"  # case-insensitive
DB_ACTION = r"\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|FIND|AGGREGATE)\b"  # case-insensitive
DB_LATENCY = r"(\d+\.?\d*)\s*(ms|s|µs)"
HTTP_REQUEST = r'"(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\s+([^\s?]+)[^"]*"'  # case-insensitive
HTTP_STATUS = r"\s([1-5]\d{2})\s"
USER_IDENTITY = r"\b([\w\.-]+@[\w\.-]+\.\w{2,}|[a-zA-Z0-9._-]+\\[a-zA-Z0-9._-]+)\b"
AUTH_OUTCOME = r"\b(SUCCESS|FAILED|DENIED|ALLOWED|CHALLENGE|LOCKED)\b"  # case-insensitive
SYSLOG_HEADER = r"\b([a-zA-Z0-9\._-]+)\[?(\d+)?\]?:\s"
DEVICE_ID = r"\b([0-9a-fA-F]{2}[:-]){5}([0-9a-fA-F]{2})\b|\bdev_[a-zA-Z0-9]{8,}\b"
METRIC = r"(\d+\.?\d*)\s*([a-zA-Z%]+)"
KEY_VALUE = r"(\w+)=([\w\.\-\/]+)|(\w+):\s*([\w\.\-\/]+)"
BRACKETED = r"[\[\(]([^\]\)]+)[\]\)]"

# --- v2 dialect: words, thresholds, labels --------------------------------
DENY_WORDS = ["DROP", "DENY", "BLOCK"]
FIREWALL_MARKS = ["ASA", "FG"]
RDBMS_WORDS = ["mysql", "postgres"]
SLOW_QUERY_MS = 100.0
SLOW_QUERY_S = 0.1
STATIC_EXTENSIONS = [".js", ".css", ".png", ".jpg", ".ico", ".svg", ".woff2"]
SERVERLESS_WORDS = ["LAMBDA", "FUNCTION"]
STORAGE_WORDS = ["S3", "BLOB"]
NETWORKING_WORDS = ["VPC", "SUBNET"]
NON_PRODUCTION_REGIONS = ["us-east-1-test", "dev-region"]
FAILURE_WORDS = ["FAILED", "DENIED", "LOCKED", "UNAUTHORIZED"]
AUTHENTICATION_WORDS = ["LOGIN", "AUTH"]
CREDENTIAL_WORDS = ["PASSWORD", "RESET"]
DELETION_WORDS = ["DELETE", "REMOVE"]
OS_INTERNAL_WORDS = ["kernel", "systemd"]
MEMORY_WORDS = ["OOM-KILLER", "OUT OF MEMORY"]
CRASH_WORDS = ["SEGFAULT", "STACK TRACE"]
INTERNAL_APP_WORDS = ["APP_INTERNAL", "PY_LOG"]
OVERHEAT_ABOVE = 50.0
LOW_POWER_BELOW = 5.0

# --- v2 dialect: source -> family ------------------------------------------
V2_SOURCES = {
    "networking": ["firewall", "router", "cisco", "fortigate"],
    "containers": ["kubernetes", "docker", "openshift", "k8s"],
    "storage": ["postgresql", "mongodb", "mysql", "database", "redis"],
    "web": ["nginx", "apache", "web_app", "ingress"],
    "cloud": ["aws", "gcp", "azure", "cloudtrail"],
    "security": ["auth", "okta", "active_directory", "siem", "vpn"],
    "system": ["syslog", "kernel", "cron", "ssh"],
    "integrations": ["stripe", "twilio", "sendgrid", "webhook"],
    "iot": ["sensor", "gateway", "telemetry", "mqtt"],
    "custom": ["custom", "internal", "app", "generic"],
}
V2_DEFAULT_FAMILY = "system"

# --- v1 dialect: patterns ---------------------------------------------------
V1_KEY_VALUE = r"""(\w+)=(["']?)(.*?)\2(?:,|\s|$)"""
V1_CRI_LINE = r"(\S+)\s+(stdout|stderr)\s+(\S+)\s+(.*)"  # anchored at the start
V1_SLOW_QUERY = r"Query_time:\s+(\d+\.\d+).*?Lock_time:\s+(\d+\.\d+)"
V1_DB_OPERATION = r"(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)\s+"  # case-insensitive
V1_ACCESS_LINE = (
    r"(\S+)\s+\S+\s+\S+\s+\[(.*?)\]\s+"
    r'"(\S+)\s+(\S+)\s+(\S+)"\s+'
    r"(\d+)\s+(\d+)"
)  # anchored at the start
V1_AUTH_ACTION = r"(login|logout|failed|success|denied)"
V1_AUTH_USER = r"user[:\s=](\S+)"
V1_AUTH_SOURCE_IP = r"from[:\s=](\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
V1_AUTH_PORT = r"port\s+(\d+)"
V1_SYSLOG_LINE = r"<(\d+)> (\w{3}\s+\d+\s\d+:\d+:\d+) (\S+) (\S+): (.*)"  # anchored at the start
V1_TELEMETRY = r"(\w+)[:=]([\d\.]+|\w+)"
V1_APP_TAG = r"\[([A-Z0-9_\-]+)\]"

# --- v1 dialect: words, thresholds, labels -----------------------------------
V1_PRIORITY_ERROR_MAX = 3
V1_PRIORITY_WARNING = 4
V1_DEFAULT_PRIORITY = "6"
V1_SLOW_QUERY_S = 1.0
V1_MESSAGE_CHARS = 500
V1_CLOUD_SEVERITIES = ["ERROR", "CRITICAL", "ALERT"]
V1_SECURITY_WARNING_WORDS = ["fail", "deny", "unauthorized", "refused"]
V1_SECURITY_ERROR_WORDS = ["critical", "attack"]
V1_INTEGRATION_FAILURE_WORDS = ["failed", "error", "denied", "rejected", "undelivered"]
V1_BAD_DEVICE_STATUS = ["CRIT", "ERR", "LOW_BATT"]
V1_OVERHEAT_ABOVE = 80
V1_ACCESS_TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"

# --- v1 dialect: source -> family ---------------------------------------------
V1_SOURCES = {
    "system": ["syslog"],
    "web": ["nginx", "apache", "web_app"],
    "cloud": ["aws", "gcp", "azure", "cloudtrail"],
    "containers": ["kubernetes", "docker", "openshift"],
    "networking": ["firewall", "router", "cisco", "fortigate"],
    "security": ["auth", "okta", "active_directory", "siem"],
    "storage": ["postgresql", "mongodb", "database"],
    "integrations": ["stripe", "twilio", "sendgrid", "webhook"],
    "iot": ["sensor", "gateway", "iot", "telemetry"],
    "custom": ["custom", "internal", "app"],
}
V1_DEFAULT_FAMILY = "system"

# --- v1 dialect: (blank reason, exception reason) per family ---------------------
V1_REASONS = {
    "networking": ("empty_network_log", "network_parse_exception"),
    "containers": ("empty_container_log", "container_parse_exception"),
    "storage": ("empty_db_log", "db_parse_exception"),
    "web": ("empty_input", "regex_exception"),
    "cloud": ("empty_cloud_payload", "cloud_json_parse_fail"),
    "security": ("empty_security_log", "security_parse_exception"),
    "integrations": ("empty_webhook_payload", "webhook_parse_exception"),
    "iot": ("empty_iot_payload", "iot_parse_exception"),
    "custom": ("empty_custom_payload", None),
}

# --- intake, admission, storage ---------------------------------------------------
RATE_LIMIT_PER_SECOND = 1000
MAX_BUFFER_DEPTH = 10000
WORKER_BATCH = 500
SINK_BATCH = 1000
LIMIT_STATE_TTL_SECONDS = 3  # the 1 s window plus 2 s
LOG_SOURCES = ["nginx", "postgresql", "kubernetes", "syslog", "generic"]
LOG_LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
TOPIC_INGESTED = "ingested_logs"
TOPIC_RAW = "logs"
TOPIC_DLQ = "logs_dlq"
PRODUCER_OPTIONS = {
    "kafka.acks": "all",
    "kafka.compression.type": "snappy",
    "kafka.linger.ms": "5",
    "kafka.batch.size": "65536",
}
STORAGE_DEFAULTS = {
    "tenant_id": "0",
    "service": "default",
    "source": "generic",
    "level": "INFO",
    "message": "",
}
HOT_DEFAULTS = {"service": "unknown", "level": "INFO", "message": ""}
LATENCY_BUCKETS = [
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
]
