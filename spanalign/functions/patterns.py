"""Fixed values.

Everything in this module is a fixed value that must equal the original
tool's definitions for results to match: the word-character class, the
language table with file extensions, the language alias table, the
languages accepted by the folder batch runner, the scale ladder of the
cost projection and the time units it prints, and the text of the
reason/explanation strings, and the pattern that splits texts before the merges
of a public byte-pair vocabulary. The other token schemes are our own
regexes.
"""

# --- fixed values: word characters (str.isalnum() or '_') ------------------
WORD_CHAR = r"[\p{L}\p{N}_]"
NON_WORD_CHAR = r"[^\p{L}\p{N}_]"
# ASCII whitespace written out so Java regex and RE2 agree (RE2's \s lacks \x0B)
WS_CHAR = r"[\t\n\x0B\f\r ]"
NON_WS_CHAR = r"[^\t\n\x0B\f\r ]"

# --- fixed values: language -> file extensions ------------------------------
LANGUAGE_EXTENSIONS = {
    "python": [".py"],
    "javascript": [".js"],
    "typescript": [".ts"],
    "java": [".java"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp"],
    "csharp": [".cs"],
    "go": [".go"],
    "ruby": [".rb"],
    "rust": [".rs"],
    "scala": [".scala"],
}

# --- fixed values: language aliases (after trim + lower) ---------------------
LANGUAGE_ALIASES = {
    "python": "python", "py": "python",
    "javascript": "javascript", "js": "javascript", "node": "javascript",
    "typescript": "typescript", "ts": "typescript",
    "java": "java",
    "c": "c",
    "c++": "cpp", "cpp": "cpp", "cxx": "cpp",
    "c#": "csharp", "csharp": "csharp", "cs": "csharp",
    "go": "go", "golang": "go",
    "ruby": "ruby", "rb": "ruby",
    "rust": "rust", "rs": "rust",
    "scala": "scala",
}

# --- fixed values: languages the folder batch runner accepts -----------------
BATCH_LANGUAGES = [
    "javascript", "typescript", "scala", "go",
    "c", "cpp", "csharp", "python", "rust",
]

# --- fixed values: language type-system categories of the charts -------------
LANGUAGE_CATEGORIES = {
    "Static Typed": ["java", "csharp", "cpp", "c", "rust", "scala", "go", "typescript"],
    "Dynamic Typed": ["python", "javascript", "ruby"],
}

# --- fixed values: cost projection scales and time units ---------------------
COST_SCALES = [
    (100, "100 files"),
    (1000, "1,000 files"),
    (10000, "10,000 files"),
    (100000, "100,000 files"),
    (1000000, "1,000,000 files"),
    (10000000, "10,000,000 files"),
    (100000000, "100,000,000 files"),
]
# (upper bound in seconds, divisor, unit); the last unit has no upper bound
TIME_UNITS = [
    (60, 1, "seconds"),
    (3600, 60, "minutes"),
    (86400, 3600, "hours"),
    (2592000, 86400, "days"),
    (31536000, 2592000, "months"),
    (None, 31536000, "years"),
]

# --- fixed values: report strings -------------------------------------------
START_REASON = "rule.start_byte=%d splits word between '%s' and '%s'"
END_REASON = "rule.end_byte=%d splits word between '%s' and '%s'"
EXPLAIN_SPAN = "Tree-sitter node '%s' spans bytes [%d, %d) from node.start_byte/end_byte."
EXPLAIN_TOKENS = "Token boundaries derived via %s; offsets mapped to UTF-8 byte positions."
TOKEN_SOURCES = ["offset_mapping", "heuristic_decode", "single_byte_fallback"]
PREVIEW_CHARS = 50

# --- our token schemes (covering regexes; each character lands in one piece) -
TOKEN_SCHEMES = {
    "word": r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]",
    "piece4": r"[\p{L}\p{N}_]{1,4}|[^\p{L}\p{N}_]",
    "ws": r"[^\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+",
    "char": r"(?s).",
    "pretok": r" ?\p{L}+| ?\p{N}+| ?[^\t\n\x0B\f\r \p{L}\p{N}]+|[\t\n\x0B\f\r ]+",
}
# alternating word / non-word runs: the M1 test stabs boundaries into word runs
RUN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"

# --- fixed values: pre-tokens of byte-level byte-pair vocabularies -----------
# white space as the vocabularies' own tools know it, written out (Java's \s is ASCII only)
BPE_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BPE_PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + BPE_SPACE + r"\p{L}\p{N}]+"
                r"|[" + BPE_SPACE + r"]+(?![^" + BPE_SPACE + r"])|[" + BPE_SPACE + r"]+")

# --- delimiters of nested spans in code (patterns in RE2 syntax) ---------------
BRACKETS = {"paren": "()", "bracket": "[]", "brace": "{}"}
# an unclosed block comment goes to the end of the text
COMMENT_STYLES = {
    "c": r"//[^\n]*|/\*[^*]*(?:\*+[^*/][^*]*)*(?:\*+/|\**\z)",
    "hash": r"#[^\n]*",
    "none": "",
}
STRING_PATTERNS = {q: rf"{q}[^{q}\\\n]*(?:\\[^\n][^{q}\\\n]*)*{q}" for q in "\"'`"}

# --- fixed values: HTML's void and raw text elements, and implied ends --------
VOID_ELEMENTS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
RAW_ELEMENTS = ["script", "style", "textarea", "title"]
# a tag whose quoted values may hold ">" but not "<"
TAG = r"</?[A-Za-z][^<>\"']*(?:\"[^\"<]*\"[^<>\"']*|'[^'<]*'[^<>\"']*)*>"
# start tags, the open elements that they end, and the elements that such an end doesn't cross
IMPLIED_ENDS = [
    (["address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer",
      "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
      "table", "ul"], ["p"], ["button", "caption", "object", "table", "td", "th"]),
    (["li"], ["li"], ["menu", "ol", "ul"]),
    (["dd", "dt"], ["dd", "dt"], ["dl"]),
    (["option"], ["option"], ["datalist", "optgroup", "select"]),
    (["optgroup"], ["optgroup", "option"], ["select"]),
    (["tbody", "tfoot", "thead"], ["tbody", "tfoot", "thead"], ["table"]),
    (["tr"], ["tr"], ["table", "tbody", "tfoot", "thead"]),
    (["td", "th"], ["td", "th"], ["table", "tr"]),
    (["body"], ["head"], ["html"]),
]
