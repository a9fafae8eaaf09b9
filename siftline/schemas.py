"""Table schemas. All times without zone are UTC."""

POSTS = (
    "channel_id BIGINT, msg_id BIGINT, kind STRING, peer_kind STRING, "
    "message STRING, date TIMESTAMP_NTZ"
)
CHANNELS = "channel_id BIGINT, title STRING, username STRING, left BOOLEAN"
WATCH = "channel_id BIGINT"
CALLS = "ARRAY<STRUCT<attempt: INT, code: INT, message: STRING, wait_us: BIGINT>>"
REPLIES = "channel_id BIGINT, msg_id BIGINT, model STRING, raw STRING, error STRING"
SCORED = f"{REPLIES}, calls {CALLS}"
VERDICTS = (
    f"channel_id BIGINT, msg_id BIGINT, model STRING, raw STRING, calls {CALLS}, "
    "match BOOLEAN, reason STRING, error STRING, message STRING"
)
FAILED = "channel_id BIGINT, msg_id BIGINT, message STRING, attempt INT, wait_us BIGINT"
MATCHES = (
    "time TIMESTAMP, channel_id BIGINT, channel STRING, msg_id BIGINT, "
    "reason STRING, link STRING, source STRING"
)
OUTBOX = "destination STRING, text STRING, dedup_id BIGINT"
QUARANTINE = "channel_id BIGINT, msg_id BIGINT, reason STRING, source STRING, cause STRING"
MARKS = "channel_id BIGINT, last_msg_id BIGINT"
PARTIALS = f"{MARKS}, analysed BIGINT, matched BIGINT, failed BIGINT"
PROGRESS = f"generation INT, since DATE, round BIGINT, {PARTIALS}"
RUNS = (
    "generation INT, since DATE, until TIMESTAMP_NTZ, event STRING, slice_days INT, "
    "round BIGINT, unit_from BIGINT, unit_to BIGINT, at TIMESTAMP_NTZ"
)
STATE_FILE = "since STRING, channels MAP<STRING, BIGINT>, done BOOLEAN"
