"""Token texts, tag groups and tables that results depend on."""

from __future__ import annotations

# Control tokens.
BOS = "<|bos|>"
EOS = "<|eos|>"
PAD = "<|pad|>"
UNK = "<|unk|>"
SEP = "<|sep|>"
MASK = "<|mask|>"
CONTROL_TOKENS = (BOS, EOS, PAD, UNK, SEP, MASK)

# Section marks of a prompt.
GENERAL_START = "<general>"
GENERAL_END = "</general>"
CHARACTER_START = "<character>"
CHARACTER_END = "</character>"
COPYRIGHT_START = "<copyright>"
COPYRIGHT_END = "</copyright>"
SECTION_TOKENS = (
    GENERAL_START,
    GENERAL_END,
    CHARACTER_START,
    CHARACTER_END,
    COPYRIGHT_START,
    COPYRIGHT_END,
)
# Older prompts also have a rating section; it is only ever parsed, never written.
RATING_START = "<rating>"
RATING_END = "</rating>"

# Rating, quality, length, aspect ratio.
RATING_TOKENS = tuple(
    f"<|rating:{r}|>" for r in ("sfw", "nsfw", "general", "sensitive", "questionable", "explicit")
)
QUALITY_TOKENS = tuple(f"<|quality:{q}|>" for q in ("best", "high", "normal", "low", "worst"))
LENGTH_TOKENS = tuple(
    f"<|length:{n}|>" for n in ("very_short", "short", "medium", "long", "very_long")
)
ASPECT_RATIO_TOKENS = tuple(
    f"<|aspect_ratio:{a}|>" for a in ("ultra_wide", "wide", "square", "tall", "ultra_tall")
)

# Fine-tuning marks.
INPUT_START = "<|input_start|>"
INPUT_END = "<|input_end|>"
KEEP_IDENTITY = "<|keep_identity|>"
IDENTITY_NONE = "<|identity:none|>"
IDENTITY_LAX = "<|identity:lax|>"
IDENTITY_STRICT = "<|identity:strict|>"
INPUT_TOKENS = (INPUT_START, INPUT_END)
IDENTITY_TOKENS = (KEEP_IDENTITY, IDENTITY_NONE, IDENTITY_LAX, IDENTITY_STRICT)
IDENTITY_TOKEN = {"none": IDENTITY_NONE, "lax": IDENTITY_LAX, "strict": IDENTITY_STRICT}


def reserved_tokens(n: int) -> tuple[str, ...]:
    """Spare tokens kept free for later use."""
    return tuple(f"<|reserved_{i}|>" for i in range(n))


# The three vocabularies differ in their special tokens; order is id order.
SPECIAL_TOKENS = {
    "main": CONTROL_TOKENS
    + SECTION_TOKENS
    + RATING_TOKENS
    + QUALITY_TOKENS
    + LENGTH_TOKENS
    + ASPECT_RATIO_TOKENS
    + INPUT_TOKENS
    + IDENTITY_TOKENS
    + reserved_tokens(64),
    "encode": CONTROL_TOKENS
    + SECTION_TOKENS
    + RATING_TOKENS
    + tuple(q for q in QUALITY_TOKENS if q != "<|quality:normal|>")
    + LENGTH_TOKENS
    + INPUT_TOKENS
    + IDENTITY_TOKENS
    + reserved_tokens(64),
    "masked": CONTROL_TOKENS + reserved_tokens(32),
}

# Short rating -> exact and coarse rating token.
EXACT_RATING = {
    "g": "<|rating:general|>",
    "s": "<|rating:sensitive|>",
    "q": "<|rating:questionable|>",
    "e": "<|rating:explicit|>",
}
COARSE_RATING = {
    "g": "<|rating:sfw|>",
    "s": "<|rating:sfw|>",
    "q": "<|rating:nsfw|>",
    "e": "<|rating:nsfw|>",
}

# Upper bounds of the length classes (exclusive), then the open class.
LENGTH_BOUNDS = (
    (10, "<|length:very_short|>"),
    (20, "<|length:short|>"),
    (30, "<|length:medium|>"),
    (40, "<|length:long|>"),
)
LENGTH_OPEN = "<|length:very_long|>"

# A copyright tag that names no franchise.
ORIGINAL = "original"

# Shares of a rating's posts at which score bands are cut.
BOUNDARY_RATIOS = (0.1, 0.25, 0.75, 0.9)

# Label id that a loss ignores; share of tokens masked.
IGNORE_LABEL = -100
MASK_RATE = 0.15
MAX_LENGTH = 256

# Tags naming how many people are shown, moved first when sections are reordered.
SECTION_PEOPLE_TAGS = (
    "1girl",
    "1boy",
    "2girls",
    "2boys",
    "3girls",
    "3boys",
    "4girls",
    "4boys",
)

# Tag groups.
PEOPLE_TAGS = (
    "1girl",
    "2girls",
    "3girls",
    "4girls",
    "5girls",
    "6+girls",
    "1boy",
    "2boys",
    "3boys",
    "4boys",
    "5boys",
    "6+boys",
    "1other",
    "2others",
    "3others",
    "4others",
    "5others",
    "6+others",
    "no humans",
)
FOCUS_TAGS = (
    "solo",
    "solo focus",
    "male focus",
    "animal focus",
    "food focus",
    "text focus",
    "still life",
)
WATERMARK_TAGS = (
    "signature",
    "logo",
    "dated",
    "artist name",
    "artist logo",
    "circle name",
    "company name",
    "copyright name",
    "copyright notice",
    "watermark",
    "sample watermark",
    "web address",
    "pawoo username",
    "pixiv username",
    "pixiv id",
    "weibo watermark",
    "weibo logo",
    "fanbox username",
    "lofter username",
    "reddit username",
    "tumblr username",
    "twitch username",
    "twitter username",
    "twitter logo",
    "gumroad username",
    "patreon username",
    "patreon logo",
    "youtube username",
    "facebook username",
    "instagram username",
    "instagram logo",
    "artstation username",
    "deviantart username",
    "furaffinity username",
    "subscribestar username",
    "hentai-foundry username",
    "creator name",
)
ARTISTIC_ERROR_TAGS = (
    "artistic error",
    "extra digits",
    "fewer digits",
    "wrong hand",
    "wrong foot",
    "bad anatomy",
    "bad hands",
    "bad feet",
    "bad reflection",
    "bad proportions",
    "bad perspective",
    "bad ass",
    "bad arm",
    "bad face",
    "bad leg",
    "bad vulva",
    "engrish text",
    "typo",
    "ranguage",
)
