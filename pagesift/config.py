"""Options and fixed values.

Values under "fixed values" must equal the behaviour being reproduced for
results to match; they are stated once here and imported everywhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# fixed values
# ---------------------------------------------------------------------------

# Elements removed together with their subtree (iframe as well) before the tree is walked.
EXCLUDED_RAW = ("script", "style")
EXCLUDED_VOID = ("meta", "img", "link", "source", "br", "hr")

# Void elements of the HTML tree builder: never pushed on the repair stack,
# serialised as "<name .../>".
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid",
    "spacer",
)

# Sentence punctuation counted per page.
PUNCTUATION = ".!?。！？"

PUNCT_KEEP_RE = r"[^.!?。！？]++"  # a run at once, not each character

# Document type declarations, class values of a serialised tag, and control characters deleted from text.
DOCTYPE_RE = r"(?s)<\s*!\s*?DOCTYPE.*?>"
CLASS_RE = r'class="([^"]*)"'
CONTROL_RE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xff]++"

# Minimum visible characters of a usable page.
MIN_VISIBLE_CHARS = 100

# Length rules applied after the classifier.
RULE_MIN_LEN = 3          # length <= 3 -> rejected
RULE_MAX_LEN_LATIN = 300  # length > 300 without CJK -> accepted
RULE_MAX_LEN_CJK = 100    # length > 100 with CJK -> accepted

# Path steps kept per node (root first) and width of one step.
MAX_STEPS = 15
EMBED_DIM = 30
STEP_WIDTH = 2 * EMBED_DIM + 2  # tag vector, class vector, text length, punctuation

# Character n-gram range of the sub-word term embedding.
NGRAM_MIN = 3
NGRAM_MAX = 6

# Epsilon of the per-step min-max normalisation.
MINMAX_EPS = 1e-16

# Cross-validation.
N_FOLDS = 4
FOLD_SEED = 42

# ---------------------------------------------------------------------------
# regular expressions (valid in Java and in Python; the DuckDB oracle has its own)
# ---------------------------------------------------------------------------

# Blanks as the parser sees them (a character class body).
BLANK = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TAG_NAME = r"[A-Za-z][^\t\n\r\f />\x00]*+"
# Blanks and attributes inside a start tag: a ">" in a quoted value does not end the tag. A value that opens a
# quote and does not close it makes the tag text. All loops are possessive, so a scan is linear and does not recurse.
ATTRIBUTE = (rf"""(?<=['"{BLANK}/])([^{BLANK}/>][^{BLANK}/=>]*+)"""
             rf"""(?:[{BLANK}]*+=++[{BLANK}]*+('[^']*+'|"[^"]*+"|(?!['"])[^>{BLANK}]*+))?+""")
ATTRIBUTE_ONLY = ATTRIBUTE.replace("([^", "(?:[^").replace("('", "(?:'")  # without groups
ATTRIBUTES = rf"(?:[{BLANK}]++|/(?!>)|{ATTRIBUTE_ONLY})*+"
START_TAG_RE = rf"<{TAG_NAME}{ATTRIBUTES}/?>"
END_TAG_RE = rf"</[A-Za-z][^>]*+>|</[{BLANK}]++[A-Za-z][-.:A-Za-z0-9_]*+[{BLANK}]*+>"
# Declarations, processing instructions, CDATA sections and end tags without a name are no text; an open comment is.
DECLARATION_RE = r"<!\[CDATA\[(?s:.*?)\]\]>|<!(?!--)[^>]*+>|<\?[^>]*+>|</[^>]*+>"
TAG_OR_DECL_RE = rf"{START_TAG_RE}|{END_TAG_RE}|{DECLARATION_RE}"
# One token = tag | declaration | what only looks like a tag (text) | text run | lone '<'.
OPEN_MARKUP_RE = r"<(?:[A-Za-z]|!--)[^>]*+>"
TOKEN_RE = rf"{TAG_OR_DECL_RE}|{OPEN_MARKUP_RE}|[^<]++|<"
# Comments and raw-text elements, found in one pass from the left, so that neither is looked for inside the other or
# inside a tag; groups: a raw element's start tag, its name, any other start tag. A raw element closed at once has no text.
COMMENT_OR_RAW_RE = (rf"(?is)<!--.*?--[{BLANK}]*+>|(<(script|style)(?=[{BLANK}/>]){ATTRIBUTES}>)"
                     rf".*?(?:</[{BLANK}]*+\2[{BLANK}]*+>|\z)|({START_TAG_RE})")
# Characters removed from node text: Python's \s plus C0 controls and U+007F-U+00FF.
PY_SPACE_RE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
CONTENT_STRIP_RE = r"[\x00-\x20\x7f-\xff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]++"
# Variant that keeps U+007F-U+00FF except the two blanks in it (U+0085, U+00A0).
CONTENT_STRIP_KEEP_LATIN1_RE = r"[\x00-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]++"
NON_WORD_RE = r"[^\p{L}\p{N}_]++"
CJK_RE = r"[\u4e00-\u9fff]"
ESCAPED_RE = r"&(amp|lt|gt);"


@dataclass(frozen=True)
class Options:
    """Behaviour switches; defaults reproduce the reference semantics."""

    scope: str = "page"            # text length / punctuation per 'page' or per 'node'
    keep_whitespace: bool = False  # collapse whitespace to one space instead of deleting it
    strip_latin1: bool = True      # delete U+007F-U+00FF from node text
    max_steps: int = MAX_STEPS
    pos_weight: str = "share"      # 'share' = neg/(pos+neg); 'ratio' = neg/pos
    fold_group: str | None = None  # None = folds per node, 'page_id' = whole pages per fold
    n_folds: int = N_FOLDS
    seed: int = FOLD_SEED
    embedding: str = "hash"        # 'hash' (E-05, deterministic) or 'w2v' (E-06, trained on characters)
    vocab_broadcast_max_terms: int = 50_000  # fitted terms broadcast at most, the most used first; others are embedded in place
    # keys of the gold join holding at least this many pages are salted over hot_key_buckets tasks
    hot_key_rows: int = 100_000
    hot_key_buckets: int = 32
    # T-09 classifier hyper-parameters (rounds = the original's epoch budget)
    max_iter: int = 30
    reg_param: float = 1e-4
    tol: float = 1e-6
    # a bound on the labelled nodes that a fit reads (equal ones of a page as one row); None: all of them
    max_train_rows: int | None = None
