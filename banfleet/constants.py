"""Fixed values.

Numbers, names and text formats that results depend on. They are stated once
here; every function takes them as defaults, so a caller can override them.
"""

# Queue and report batches
BATCH_SIZE = 500
FLUSH_SECONDS = 30
FLUSH_EARLY_AT = 50
FINAL_FLUSHES = 5
QUEUE_TTL_SECONDS = 7 * 86400
QUEUE_QUOTA_BYTES = 100 * 1024 * 1024
QUOTA_DROP_CHUNK = 100

# Delivery
BACKOFF_MIN = 1
BACKOFF_MAX = 60
BACKOFF_MAX_EXPONENT = 6
BACKOFF_JITTER = (0.5, 1.5)
RETRY_AFTER_FLOOR = 60
QUOTA_HOLD_FACTOR = 5
QUOTA_HOLD_CAP = 900
IDEMPOTENCY_WINDOW_SECONDS = 24 * 3600

# Circuit breaker
BREAKER_FAILURES_TO_OPEN = 10
BREAKER_COOLDOWN_SECONDS = 60
BREAKER_COOLDOWN_CAP = 900

# Blocklist feed
DELTA_PAGE_CAP = 50
DEFAULT_SOURCE = "tenant"
GLOBAL_SOURCE = "global"
BAN_SECONDS = 604800

# Heartbeat and status
HEARTBEAT_SECONDS = 60
HEARTBEAT_SECONDS_DEGRADED = 300
RECENT_LIMIT = 50
RECENT_ROWS = 10
COVERAGE_CELLS = 20
BAR_FULL = "▓"
BAR_EMPTY = "░"
NO_VALUE = "—"

# Inventory
TRUE_WORDS = ("1", "true", "yes", "on")
MIN_VERSION = (0, 10)
API_KEY_PATTERN = "^ab_(live|test)_[A-Za-z0-9]{16,}$"

# Text formats
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
KV_BLOCKLIST_CURSOR = "blocklist_cursor"
KV_GLOBAL_CURSOR = "global_cursor"
KV_PID = "fail2ban_pid"
KV_SNAPSHOT = "status_snapshot"
KV_FEED_STATS = "feed_stats"
