"""They must equal what callers, feeds and models already use."""

# Unicode White_Space, the set stripped by ``utrim``.
WHITE_SPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Link shapes.
LINK_HOST = "https://t.me/"
LINK_PRIVATE = "https://t.me/c/"
DESTINATION_SCHEMES = ("https://", "http://", "tg://")
DESTINATION_WWW = "www."
DESTINATION_HOSTS = ("t.me/", "telegram.me/", "telegram.dog/")
INVITE_PLUS = "+"
INVITE_JOIN = "joinchat/"
SELF_DESTINATIONS = ("me", "self")

# Notification template.
NOTE_HEADER = "✅ Подходящая вакансия\n\n📢 Канал: "
NOTE_REASON = "\n💡 "
NOTE_EXCERPT = "\n\n📝 "
NOTE_LINK = "\n\n🔗 "
ELLIPSIS = "…"
EXCERPT_CHARS = 3500
DIAGNOSTIC_BYTES = 200

# Defaults.
DEFAULT_MODEL = "gemma-4-26b-a4b-it"
DEFAULT_RPM = 25
DEFAULT_MAX_AGE_S = 900
TEXT_FAMILY_PREFIX = "gemma"

# Retry policy.
MAX_RETRIES = 3
BACKOFF_BASE_S = 10
RETRY_MARGIN_S = 1
RETRY_HINT = r"retry in ([0-9]+(?:\.[0-9]+)?)s"
QUOTA_CODE = 429
QUOTA_PHRASES = ("Error 429", "RESOURCE_EXHAUSTED", "exceeded your current quota")

# Two-line replies.
YES_WORDS = ("yes", "true", "да")
NO_WORDS = ("no", "false", "нет")
# What the prompt asks for as the reason; a reply that repeats it echoes the prompt.
REASON_ASK = "short sentence in Russian, 140 characters at most"
ECHO_PHRASES = ("short russian sentence", "max 140 chars", REASON_ASK.lower(), "with the actual reason")
ECHO_WORDS = ("string", "reason", "placeholder", "tbd", "n/a")
QUOTE_MARKS = "\"'`"

# Framing of a post for a model that takes one text input.
POST_OPEN = "\n\n---\nPOST:\n"
POST_CLOSE = "\n---\nThe post ends here. Write the MATCH line, then the REASON line, as plain text."

# Message and peer kinds, match sources.
KIND_MESSAGE = "message"
PEER_CHANNEL = "channel"
SOURCE_LIVE = "live"
SOURCE_BACKFILL = "backfill"

# Reply error classes.
ERR_EMPTY_POST = "empty_post"
ERR_EMPTY_RESPONSE = "empty_response"
ERR_NO_CONTENT = "no_content"
ERR_NO_TEXT = "no_text"
ERR_NO_MATCH_LINE = "no_match_line"
ERR_TEMPLATE_ECHO = "template_echo"
ERR_NO_JSON_OBJECT = "no_json_object"
ERR_UNBALANCED_JSON = "unbalanced_json"
ERR_DECODE = "decode_error"
ERR_QUOTA = "quota"
ERR_CALL_FAILED = "call_failed"
ERR_NO_REPLY = "no_reply"
