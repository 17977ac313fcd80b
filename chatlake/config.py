"""Engine parameters.

Everything that the operators need to know about "the bot" — its own id, the
command prefix, defaults for room settings, context limits — lives in one
frozen dataclass that is passed explicitly to the operators.  Nothing is
read from global state, so two pipelines with different parameters can run
in the same Spark session.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values (behaviour that must match the original bot)
# ---------------------------------------------------------------------------
# Context limits when nothing is configured.
DEFAULT_MAX_MESSAGES = 30
DEFAULT_MAX_TOKENS = 4000
# Image box (long side, short side); 0 disables resizing.
DEFAULT_IMAGE_LONG_SIDE = 2000
DEFAULT_IMAGE_SHORT_SIDE = 768
# Request retries for model calls.
DEFAULT_RETRY_ATTEMPTS = 5
DEFAULT_RETRY_INTERVAL_SEC = 2
# System message used when a room has none.
DEFAULT_SYSTEM_MESSAGE = "You are a helpful assistant."
# Log levels, in increasing order of severity.
LOG_LEVELS = ["trace", "debug", "info", "warning", "error", "critical"]
# Room settings that hold a boolean stored as "1"/"0", with their default.
BOOLEAN_SETTINGS = {
    "use_classification": False,
    "use_timing": False,
    "always_reply": True,
    "tts": False,
    "stt": False,
}
# Setting aliases accepted by the settings command.
SETTING_ALIASES = {
    "classification": "use_classification",
    "timing": "use_timing",
    "systemmessage": "system_message",
}
# Models that can call tools natively.
TOOL_MODELS = ["gpt-3.5-turbo", "gpt-4-turbo", "gpt-4o"]
# Models that accept images natively (besides any name containing "vision").
VISION_MODELS = ["gpt-4-turbo", "gpt-4o"]
# Message kinds (event types / msgtypes) the context builder understands.
TEXT_KIND = "m.text"
NOTICE_KIND = "m.notice"
IMAGE_KIND = "m.image"
AUDIO_KIND = "m.audio"
FILE_KIND = "m.file"
VIDEO_KIND = "m.video"
MEDIA_KINDS = [IMAGE_KIND, AUDIO_KIND, FILE_KIND, VIDEO_KIND]
MEMBER_STATE = "m.room.member"
AVATAR_STATE = "m.room.avatar"
# Image sizes chosen by a leading orientation flag.
ORIENTATION_SIZES = {"portrait": "1024x1792", "landscape": "1792x1024", "square": "1024x1024"}
# Tool argument defaults.
TOOL_DEFAULTS = {
    "dice": {"dice": "6"},
    "wikipedia": {"language": "en", "summarize": "false"},
    "imagine": {"orientation": "square"},
    "newroom": {"name": "Bot"},
}
# Required tool arguments.
TOOL_REQUIRED = {
    "dice": [],
    "geocode": ["location"],
    "imagine": ["prompt"],
    "newroom": [],
    "weather": ["latitude", "longitude"],
    "webrequest": ["url"],
    "websearch": ["query"],
    "wikipedia": ["query"],
}
# Command names known to the command router (an unknown name goes to the
# fallback handler).
COMMANDS = [
    "help", "newroom", "stats", "botinfo", "coin", "ignoreolder",
    "systemmessage", "imagine", "calculate", "classify", "chat", "custom",
    "privacy", "roomsettings", "dice", "parcel", "space", "tts",
]
# Tool names known to the tool router.
TOOLS = [
    "weather", "geocode", "dice", "websearch", "webrequest", "imagine",
    "imagedescription", "wikipedia", "datetime", "newroom",
]
# Api code under which parcel lookups are logged (one unit per call).
PARCEL_API_CODE = "parcel"
# Texts the bot sends or reports (placeholders in braces).
DENY_NOTICE = "You are not allowed to use this bot. Please contact {operator} for more information."
TOOL_NOT_FOUND = "Error: Tool not found"
TOOL_FAILED = "Error: Something went wrong calling tool {tool}"
CALC_FAILED = "Could not process your query."
CALC_DID_YOU_MEAN = "Did you mean: {suggestion}"
WEB_REPORT = "**Web request**\nURL: {url}\nStatus: {status} {reason}\n\n{text}\n"
WIKI_REQUEST = "https://{language}.wikipedia.org/w/api.php?{query}"
WIKI_REQUEST_ARGS = [("action", "query"), ("format", "json"), ("titles", None), ("prop", "revisions"),
                     ("rvprop", "content")]
WIKI_REPORT = "**Wikipedia: {title}**\n{content}"
WIKI_NO_RESULTS = "No results for {query} found in Wikipedia."
WEATHER_REPORT = (
    "**Weather report{for_name}**\n"
    "Current: {temp}°C, {description}\n"
    "Feels like: {feels_like}°C\n"
    "Humidity: {humidity}%\n"
    "Wind: {wind_speed}m/s\n"
    "Sunrise: {sunrise}\n"
    "Sunset: {sunset}\n"
    "\n"
    "Today: {day0}°C, {description0}, {summary0}\n"
    "Tomorrow: {day1}°C, {description1}, {summary1}\n"
)
SEARCH_HEADER = "**Search results for {query}**"
SEARCH_RESULT = "\n{title}\n{url}\n{description}\n"
CARRIER_LINE = "* {name} - {code}"
ROOM_INFO = (
    "GPT Room info:\n"
    "\n"
    "Model: {model}\n"
    "\n"
    "Maximum context tokens: {max_tokens}\n"
    "\n"
    "Maximum context messages: {max_messages}\n"
    "\n"
    "Bot user ID: {bot_id}\n"
    "\n"
    "Current room ID: {room_id}\n"
    "\n"
    "System message: {system_message}\n"
)
LOG_LINE = "[{ts}] - {caller} - [{level}] {message}"
LOG_TS_FORMAT = "yyyy-MM-dd HH:mm:ss:SSSSSS"
DATA_URL = "data:{mimetype};base64,{payload}"
HTML_MESSAGE_FORMAT = "org.matrix.custom.html"
SPACE_CHILD_EVENT = "m.space.child"
ROOM_PARENT_EVENT = "m.room.parent"
# Sub-commands of the space command.
SPACE_SUBCOMMANDS = ["enable", "disable", "update", "invite"]


@dataclass(frozen=True)
class BotConfig:
    """Parameters of one bot identity.

    ``prefix`` is the command prefix (``!bot`` in the fixtures);
    ``custom_kind_prefix`` marks custom message kinds that always enter the
    context window.
    """

    bot_id: str = "@bot:alpha.example"
    prefix: str = "!bot"
    custom_kind_prefix: str = "bot"
    max_messages: int = DEFAULT_MAX_MESSAGES
    max_tokens: int = DEFAULT_MAX_TOKENS
    default_system_message: str = DEFAULT_SYSTEM_MESSAGE
    force_system_message: bool = False
    chat_model: str = "gpt-4o"
    tool_model: str | None = None
    allow_model_override: bool = False
    force_tools: bool = False
    emulate_tools: bool = False
    image_model: str = "dall-e-3"
    image_long_side: int = DEFAULT_IMAGE_LONG_SIDE
    image_short_side: int = DEFAULT_IMAGE_SHORT_SIDE
    force_vision: bool = False
    force_video: bool = False
    allowed_users: tuple[str, ...] = field(default_factory=tuple)
    operator: str | None = None         # an unset operator renders as "None" in notices

    def with_(self, **kw) -> "BotConfig":
        return replace(self, **kw)

    @property
    def vision(self) -> bool:
        """Images enter the prompt when the chat model takes them (or forced)."""
        return self.chat_model in VISION_MODELS or "vision" in self.chat_model or self.force_vision

    @property
    def video(self) -> bool:
        """Video enters the prompt only when forced."""
        return self.force_video


DEFAULT_CONFIG = BotConfig()
