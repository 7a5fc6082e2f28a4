"""Values that define results: word lists, character sets, limits."""

# White space and line ends as the engine counts them (bodies of character classes).
WHITE = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
# Stop words by language, in the order that breaks ties of the vote.
STOPWORDS = {
    "es": ("que", "de", "la", "el", "en", "los", "una", "por", "con", "para"),
    "en": ("the", "and", "of", "to", "in", "that", "for", "with", "was", "his"),
    "fr": ("les", "des", "une", "que", "dans", "pour", "est", "qui", "pas", "sur"),
    "de": ("der", "die", "und", "das", "nicht", "ein", "mit", "ist", "von", "sich"),
    "it": ("che", "di", "il", "non", "per", "una", "con", "del", "gli", "sono"),
    "pt": ("que", "de", "não", "uma", "para", "com", "os", "do", "da", "em"),
}
LEAST_VOTES = 5
# Real words of one letter; characters that end a sentence line.
SINGLE_WORDS = "aeoyiu"
TERMINAL = ".!?…:”»)"
# Numerals and measure words of the number grammar.
NUMERALS = "〇零一二两三四五六七八九十百千万亿几半"
MEASURES = "个只条块座名年月天次步位件章场遍岁层家口点分"
# Tone-marked vowels, tones 1 to 5.
TONES = {"a": "āáǎàa", "e": "ēéěèe", "i": "īíǐìi", "o": "ōóǒòo", "u": "ūúǔùu", "v": "ǖǘǚǜü"}
# Thresholds and reconstruction levels of the two quantiser tunings.
TUNINGS = {"even": ((43, 128, 213), (0, 85, 170, 255)), "x4": ((30, 50, 140), (15, 30, 80, 210))}
# Characters a URL must not hold, and those a file name must not hold.
UNSAFE_IN_URL = '"<>\\^`{|}'
UNSAFE_IN_NAME = '/\\:*?"<>|'
# Limits of page triage: characters of a text page, coverage of an image page, shares that raise flags.
TEXT_PAGE_CHARS = 100
IMAGE_PAGE_COVERAGE = 0.3
DOUBLED_LINES_OVER, STRAY_SINGLES_OVER = 0.10, 0.02
DEDUPE_UNDER = 0.7
# File endings of sidecars, in order of preference.
TRANSCRIPT_ENDINGS = ("md", "markdown", "txt", "text")
COVER_ENDINGS = ("png", "jpg", "jpeg", "webp", "tiff", "tif", "bmp", "gif")
# Ranges of wide characters (ideographs, extension A, compatibility, signs, full-width forms); what XML forbids.
WIDE = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0x3000, 0x303F), (0xFF00, 0xFFEF))
NOT_XML = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
# Bounds of a correction: share of changed characters, longest span, net growth.
MAX_CHANGED, MAX_SPAN, MAX_GROWTH = 0.02, 24, 0.01
# What a report says of a broken bound: the figure, the bound.
EDIT_REASONS = {
    "changed": "changed_ratio %s > %s (too much of the text edited)",
    "span": "max_edit_span %s > %s (an edit is a rewrite, not a local fix — use policy)",
    "growth": "net_growth %s > %s (text added/removed wholesale, not corrected)",
}
# The panel, its levels, the most enlargement, the least mat, the largest bitmap.
PANEL_W, PANEL_H = 528, 792
LEVELS = (0, 85, 170, 255)
LUMA = (29, 150, 77)  # blue, green, red, of 256
LEVEL_BOUNDS = (42.5, 127.5, 212.5)
MAX_UPSCALE, MIN_MAT_AREA = 1.5, 0.06
MAX_IMAGE_W, MAX_IMAGE_H = 2048, 3072
# What a bitmap reader reports, in the order in which it checks.
BITMAP_ERRORS = {
    "short": "FileInvalid",
    "magic": "NotBMP (missing 'BM')",
    "dib": "DIBTooSmall (<40 bytes)",
    "planes": "BadPlanes (!= 1)",
    "depth": "UnsupportedBpp (expected 1, 2, 4, 8, 24, or 32)",
    "compression": "UnsupportedCompression (expected BI_RGB or BI_BITFIELDS for 32bpp)",
    "colours": "PaletteTooLarge",
    "dimensions": "BadDimensions",
    "large": "ImageTooLarge (max 2048x3072)",
    "palette": "FileInvalid",
    "offset": "SeekPixelDataFailed",
}
# Places that get a share of a pixel's error (right, down) and the share, for each kernel.
SIX = ((1, 0), (2, 0), (-1, 1), (0, 1), (1, 1), (0, 2))
KERNELS = {"atkinson": {at: 1 / 8 for at in SIX}, "floyd": {(1, 0): 7 / 16, (-1, 1): 3 / 16, (0, 1): 5 / 16, (1, 1): 1 / 16}}
NOISE_SHARE, NOISE_SIGMA = 0.55, 1.6
# Tone: percent cut off at each end, power of the curve, factor of the sharpening; red, green, blue of 65536.
CUTOFF, GAMMA, SHARPNESS = 0.5, 0.85, 1.35
GREY = (19595, 38470, 7471)
# Mats: band of an edge, panel width over blur radius, contrast of the blur, waves' periods, number, depth and slope.
EDGE_BAND = 0.08
BLUR_DIVISOR, BLUR_CONTRAST = 12, 0.55
WAVE_PERIOD, WAVES, WAVE_DEPTH, WAVE_SLOPE = (90.0, 220.0), 3, 3, 0.35
# Sizes of titles, and a line's height over its type's.
TITLE_SIZES, LINE_SPACING = tuple(range(12, 161, 2)), 1.15
# Hops of a redirected address, the answers that mean one, and the client's name.
MAX_REDIRECTS, REDIRECTS, USER_AGENT = 5, (301, 302, 303, 307, 308), "lectern"
# Sizes that a user interface's font needs.
UI_SIZES = (8, 10, 12)
# Length of a slug, of a short gloss, of a preview.
SLUG_LENGTH, GLOSS_LENGTH, PREVIEW_LENGTH = 60, 110, 1200
# Statuses of finished chapters.
DONE = ("accepted", "drafted-and-validated")
# Classes of a chapter's elements, headings of its lists, the sign that leads back.
CLASSES = {"reading": "rd", "note": "fnref", "note_back": "fnback", "word": "glm", "word_back": "gback", "listed_word": "gw", "listed_reading": "gp", "listed_gloss": "gg"}
SECTIONS = {"endnotes": "Notes", "glossary": "生词 New words"}
BACK = "↩"
# What the format of books prescribes: name spaces, media types, roles; the date that all books carry.
HTML_SPACE, OPS_SPACE, OPF_SPACE = "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops", "http://www.idpf.org/2007/opf"
DUBLIN_CORE, CONTAINER_SPACE = "http://purl.org/dc/elements/1.1/", "urn:oasis:names:tc:opendocument:xmlns:container"
XHTML, COVER_ROLE, BOOK_ID = "application/xhtml+xml", "cover-image", "bookid"
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
BOOK_DATE = (2026, 1, 1)
