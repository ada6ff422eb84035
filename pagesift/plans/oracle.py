"""DuckDB oracle: the same semantics written as plain SQL over the parquet views.

Independent of the Spark code path: the per-page stack fold is a recursive
CTE that takes one token or pops one element per step, and node text is
assigned with window functions. Entity decoding uses the entities of the
test corpus (quot, apos, copy, middot, lt, gt, nbsp, #39, amp — amp last so
the chain equals one left-to-right pass); the Spark side decodes all HTML5
references. The markup patterns are written for this module alone, in RE2's
syntax (no look-around, no possessive loops), from the rules of the parser.
"""

from __future__ import annotations

from pagesift import config as C

VOIDS = ", ".join(f"'{t}'" for t in C.VOID_TAGS)
STRIP_RE = r"[\x01-\x20\x7f-\xff\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK_RE = r"[\x{4e00}-\x{9fff}]"


def decode(x: str) -> str:
    for ent, ch in (("quot", "'\"'"), ("apos", "''''"), ("copy", "'©'"), ("middot", "'·'"),
                    ("lt", "'<'"), ("gt", "'>'"), ("nbsp", "chr(160)")):
        x = f"regexp_replace({x}, '&{ent};?', {ch}, 'g')"
    x = f"replace({x}, '&#39;', '''')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


# -- markup, by the rules of the parser ---------------------------------------
BL = r"[\t-\r ]"
SEP = r"[\t-\r /]"
KEY = r"[^\t-\r />][^\t-\r /=>]*"
EQ = rf"{BL}*=+{BL}*"
QUOTED = r"""(?:'[^']*'|"[^"]*")"""
BARE = r"""[^'"\t-\r >][^\t-\r >]*"""
# attributes that follow one another without a blank: only a quoted value lets the next one begin
CHAIN = rf"(?:{KEY}{EQ}{QUOTED})*(?:{KEY}(?:{EQ}(?:{BARE})?)?)?"
ATTRS = rf"(?:{SEP}+{CHAIN})*{SEP}*"
# the same before "/>": an unquoted value would take the slash, so a blank has to end it
CLOSED = rf"(?:{SEP}+(?:{KEY}{EQ}{QUOTED})*(?:{KEY}(?:{EQ}(?:{BARE})?{BL})?)?)*{SEP}*/>"
NAME = r"[A-Za-z][^\t\n\r\f />]*"
START = rf"<{NAME}{ATTRS}>"
END = rf"</[A-Za-z][^>]*>|</{BL}+[A-Za-z][-.:A-Za-z0-9_]*{BL}*>"
DECL = r"<!\[CDATA\[(?s:.*?)\]\]>|<!-?>|<!-?[^->][^>]*>|<\?[^>]*>|</[^>]*>"
TAG_OR_DECL = f"{START}|{END}|{DECL}"
MARKUP = f"({START})|{END}|{DECL}|<(?:[A-Za-z]|!--)[^>]*>"
TOKEN = f"{TAG_OR_DECL}|<(?:[A-Za-z]|!--)[^>]*>|[^<]+|<"
ATTR = rf"{KEY}(?:{EQ}(?:{QUOTED}|{BARE})?)?"
COMMENT = rf"<!--.*?--{BL}*>"
GONE = "meta|img|link|source|br|hr|iframe"


def lit(pattern: str) -> str:
    """A pattern as a SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


def raw_element(name: str) -> tuple[str, str]:
    """Start tag and body of an element whose content is text."""
    return f"<{name}{ATTRS}>", f".*?(?:</{BL}*{name}{BL}*>|$)"


def clean_html(x: str) -> str:
    x = f"replace({x}, chr(10), '')"
    x = decode(x)
    x = f"regexp_replace({x}, '(?s)<\\s*!\\s*?DOCTYPE.*?>', '', 'g')"
    raw = "|".join("".join(raw_element(n)) for n in ("script", "style"))
    x = f"regexp_replace({x}, {lit(f'(?is){COMMENT}|(<(?:script|style){CLOSED})|{raw}|({START})')}, '\\1\\2', 'g')"
    iframe = f"<iframe{CLOSED}|<iframe{ATTRS}>.*?</iframe{BL}*>"
    return (f"regexp_replace({x}, {lit(f'(?is){iframe}|<(?:{GONE}|script|style){ATTRS}>|</(?:{GONE})(?:{SEP}[^>]*)?>|({START})')},"
            " '\\1', 'g')")


def escape(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def norm_fragment(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '&(amp|lt|gt);', '', 'g'), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def punct(x: str) -> str:
    return f"length(regexp_replace({x}, '[^.!?。！？]', '', 'g'))"


SQ = "'" * 4  # SQL literal holding one single quote


def _value(a: str) -> str:
    """The value of an attribute's text, without its quotes."""
    v = f"regexp_extract({a}, {lit(f'(?s)^{KEY}{EQ}(.*)$')}, 1)"
    return (f"CASE WHEN length({v}) >= 2 AND ((left({v}, 1) = '\"' AND right({v}, 1) = '\"') OR "
            f"(left({v}, 1) = {SQ} AND right({v}, 1) = {SQ})) THEN substring({v}, 2, length({v}) - 2) ELSE {v} END")


def _key(a: str) -> str:
    return f"lower(regexp_extract({a}, {lit(f'^({KEY})')}, 1))"


def _canon_attr(a: str) -> str:
    v = decode(f"({_value(a)})")
    v = f"CASE WHEN {_key(a)} = 'class' THEN trim(regexp_replace({v}, '\\s+', ' ', 'g')) ELSE {v} END"
    return f"{_key(a)} || '=\"' || {escape(v)} || '\"'"


def attributes(t: str) -> str:
    """The attribute texts of a start tag."""
    return f"regexp_extract_all(regexp_replace(substring({t}, 2, length({t}) - 2), {lit('^' + NAME)}, ''), {lit(ATTR)})"


CANON_ATTR = _canon_attr("a")

BASE = f"""
cl0 AS (
  SELECT page_id, url, {clean_html('html')} AS html FROM pages
),
cl AS (
  SELECT page_id, url, html,
         CAST(length(replace(regexp_replace(html, {lit(TAG_OR_DECL)}, '', 'g'), '\\', '')) AS BIGINT) AS visible_len
  FROM cl0
),
cls AS (
  SELECT *, CASE WHEN html IS NULL THEN 'no_html'
                 WHEN visible_len < {C.MIN_VISIBLE_CHARS} THEN 'too_short'
                 WHEN NOT regexp_matches(html, {lit('(?i)<html' + ATTRS + '>')}) THEN 'no_html'
                 ELSE 'ok' END AS status
  FROM cl
),
tk0 AS (
  SELECT page_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i
  FROM (SELECT page_id, regexp_extract_all(html, {lit(TOKEN)}) AS toks FROM cls WHERE status = 'ok')
),
tk1 AS (
  SELECT page_id, i, t, ttype, CASE WHEN ttype = 'start' THEN lower(regexp_extract(t, '^<([A-Za-z][^\\t\n\\r\f />]*)', 1))
                                    WHEN ttype = 'end' THEN lower(regexp_extract(t, '^</[\\t-\\r ]*([A-Za-z][^\\t-\\r />]*)', 1)) ELSE '' END AS tname,
         CASE WHEN ttype = 'start' THEN {attributes('t')} END AS araw
  FROM (SELECT *, CASE WHEN regexp_full_match(t, {lit(END)}) THEN 'end'
                       WHEN regexp_full_match(t, {lit(START)}) THEN 'start'
                       WHEN regexp_full_match(t, {lit(DECL)}) THEN 'decl' ELSE 'text' END AS ttype FROM tk0)
),
tk2 AS (
  SELECT page_id, i, 0 AS sub, t, ttype, tname, araw FROM tk1
  UNION ALL
  SELECT page_id, i, 1, '</' || tname || '>', 'end', tname, NULL FROM tk1
  WHERE ttype = 'start' AND t LIKE '%/>' AND coalesce(araw[-1], '') NOT LIKE '%/' AND tname NOT IN ({VOIDS})
),
tka AS (
  SELECT *, list_transform(araw, lambda a: {CANON_ATTR}) AS attrs
  FROM tk2
),
tkr AS (
  SELECT *, CASE WHEN ttype = 'start' THEN
           tname || CASE WHEN len(attrs) = 0 THEN '' ELSE ' ' || array_to_string(attrs, ' ') END
                 || CASE WHEN tname IN ({VOIDS}) THEN '/' ELSE '' END END AS raw
  FROM tka
),
tkx AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i, sub) AS INTEGER) AS j,
         t, ttype, tname, sub = 1 AS selfclose_end, raw,
         CASE WHEN ttype = 'start' THEN split_part(raw, ' ', 1) ELSE '/' || tname END AS pname,
         CASE WHEN ttype = 'start' THEN regexp_extract(raw, 'class="([^"]*)"', 1) ELSE '' END AS cls
  FROM tkr
),
npg AS (SELECT page_id, max(j) AS n FROM tkx GROUP BY page_id),
fold(page_id, j, n, started, done, rs, pn, pp, npos, e_pos, e_kind, e_name, e_tok, e_syn, e_anc) AS (
  SELECT page_id, 1, n, false, false, []::VARCHAR[], []::VARCHAR[], []::INTEGER[], 0,
         NULL::INTEGER, NULL::VARCHAR, NULL::VARCHAR, NULL::INTEGER, NULL::BOOLEAN, NULL::INTEGER[]
  FROM npg
  UNION ALL
  SELECT page_id,
         CASE WHEN act IN ('pop', 'eof') THEN j ELSE j + 1 END,
         n,
         started OR act = 'open',
         CASE WHEN act IN ('close', 'pop', 'eof') THEN len(rs) = 1 ELSE false END,
         CASE WHEN act = 'open' THEN (CASE WHEN tname IN ({VOIDS}) THEN rs ELSE list_append(rs, tname) END)
              WHEN act IN ('close', 'pop', 'eof') THEN rs[:len(rs) - 1] ELSE rs END,
         CASE WHEN act = 'open' THEN list_append(pn, pname)
              WHEN act IN ('close', 'pop', 'eof') THEN pn[:k - 1] ELSE pn END,
         CASE WHEN act = 'open' THEN list_append(pp, npos)
              WHEN act IN ('close', 'pop', 'eof') THEN pp[:k - 1] ELSE pp END,
         CASE WHEN act = 'skip' THEN npos ELSE npos + 1 END,
         CASE WHEN act = 'skip' THEN NULL ELSE npos END,
         CASE WHEN act = 'open' THEN 'start' WHEN act = 'skip' THEN NULL ELSE 'end' END,
         CASE WHEN act = 'open' THEN tname WHEN act = 'skip' THEN NULL ELSE rs[-1] END,
         CASE WHEN act IN ('open', 'close', 'pop') THEN j END,
         CASE WHEN act = 'open' THEN false WHEN act = 'close' THEN selfclose_end
              WHEN act = 'skip' THEN NULL ELSE true END,
         CASE WHEN act = 'open' THEN pp WHEN act = 'skip' THEN NULL ELSE pp[:k - 1] END
  FROM (
    SELECT s.*,
           CASE WHEN act IN ('close', 'pop', 'eof') THEN
             coalesce(len(pn) - list_position(list_reverse(pn), rs[-1]) + 1, 0) END AS k
    FROM (
      SELECT f.*, x.ttype, x.tname, x.pname, x.selfclose_end,
             CASE WHEN f.j > f.n THEN 'eof'
                  WHEN NOT f.started AND x.ttype = 'start' AND x.tname = 'html' THEN 'open'
                  WHEN NOT f.started THEN 'skip'
                  WHEN x.ttype = 'start' THEN 'open'
                  WHEN x.ttype = 'end' AND f.rs[-1] = x.tname THEN 'close'
                  WHEN x.ttype = 'end' AND list_contains(f.rs, x.tname) THEN 'pop'
                  ELSE 'skip' END AS act
      FROM fold f LEFT JOIN tkx x ON x.page_id = f.page_id AND x.j = f.j
      WHERE NOT f.done AND (f.j <= f.n OR (f.started AND len(f.rs) > 0))
    ) s
  ) q
),
ev AS (
  SELECT f.page_id, f.e_pos AS pos, f.e_kind AS kind, f.e_name AS name, f.e_syn AS synthetic,
         f.e_tok AS tok, f.e_anc AS anc,
         CASE WHEN f.e_kind = 'start' THEN x.raw ELSE '/' || f.e_name END AS raw,
         CASE WHEN f.e_kind = 'start' THEN x.pname ELSE '/' || f.e_name END AS tag,
         CASE WHEN f.e_kind = 'start' THEN x.cls ELSE '' END AS class_name
  FROM fold f LEFT JOIN tkx x ON x.page_id = f.page_id AND x.j = f.e_tok AND f.e_kind = 'start'
  WHERE f.e_kind IS NOT NULL
),
own AS (
  SELECT x.page_id, x.j, x.t,
         (SELECT max(e.pos) FROM ev e WHERE e.page_id = x.page_id AND e.tok < x.j) AS owner
  FROM tkx x WHERE x.ttype = 'text'
),
runs AS (
  SELECT page_id, owner AS pos, string_agg(t, '' ORDER BY j) AS run
  FROM own WHERE owner IS NOT NULL GROUP BY page_id, owner
),
evr AS (
  SELECT e.*, regexp_replace({escape("replace(" + decode("coalesce(r.run, '')") + ", '\\', '')")}, '{STRIP_RE}', '', 'g') AS r
  FROM ev e LEFT JOIN runs r ON r.page_id = e.page_id AND r.pos = e.pos
),
nd AS (
  SELECT page_id, pos, kind, name, synthetic, raw, tag, class_name, anc AS anc_pos,
         anc[-1] AS parent_pos, len(anc) + 1 AS depth,
         CASE WHEN lag(kind) OVER w = 'end' THEN lag(r) OVER w ELSE '' END
           || CASE WHEN kind = 'start' THEN r ELSE '' END AS content
  FROM evr WINDOW w AS (PARTITION BY page_id ORDER BY pos)
),
pf AS (
  SELECT page_id, CAST(sum(length(content)) AS BIGINT) AS text_len,
         CAST(sum({punct('content')}) AS BIGINT) AS punct
  FROM nd GROUP BY page_id
),
ptags AS (SELECT page_id, list(tag ORDER BY pos) AS tags FROM nd GROUP BY page_id),
npath AS (
  SELECT n.*, array_to_string(list_concat(list_select(p.tags, list_transform(n.anc_pos, lambda a: a + 1)), [n.raw]), '>') AS path
  FROM nd n JOIN ptags p USING (page_id)
),
pdoc AS (
  SELECT page_id, CAST(regexp_extract(url, '/[a-z]{{2}}/([0-9]+)', 1) AS BIGINT) AS doc_id,
         regexp_extract(url, '/([a-z]{{2}})/[0-9]+', 1) AS url_lang
  FROM pages
),
gold AS (
  SELECT doc_id, lang, regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS gold_norm FROM documents
),
lab AS (
  SELECT n.page_id, n.pos, n.content, g.lang,
         CASE WHEN length(n.content) > 3 AND contains(g.gold_norm, {norm_fragment('n.content')}) THEN 1 ELSE 0 END AS label
  FROM nd n JOIN pdoc d USING (page_id) JOIN gold g ON g.doc_id = d.doc_id
  WHERE n.content <> ''
)
"""


def _mask(x: str) -> str:
    (script, s_body), (style, y_body) = raw_element("script"), raw_element("style")
    return (f"regexp_replace({x}, {lit(f'(?is){COMMENT}|(<(?:script|style){CLOSED})|({script}){s_body}|({style}){y_body}|({START})')},"
            " '\\1\\2\\3\\4', 'g')")


VOCAB = f"""
rawtags AS (
  SELECT page_id, t FROM (SELECT page_id, unnest(regexp_extract_all({_mask('html')}, {lit(MARKUP)}, 1)) AS t FROM pages) WHERE t <> ''
),
tag_vocab AS (
  SELECT lower(regexp_extract(t, '^<([A-Za-z][^\\t\\n\\r\\f />]*)', 1)) AS term,
         CAST(count(DISTINCT page_id) AS BIGINT) AS pages, CAST(count(*) AS BIGINT) AS uses
  FROM rawtags GROUP BY 1
),
class_vocab AS (
  SELECT term, CAST(count(*) AS BIGINT) AS uses FROM (
    SELECT trim(regexp_replace({_value('a')}, '\\s+', ' ', 'g')) AS term
    FROM (SELECT list_filter({attributes('t')}, lambda a: {_key('a')} = 'class' AND regexp_matches(a, {lit(f'^{KEY}{EQ}')}))[1] AS a FROM rawtags)
    WHERE a IS NOT NULL) WHERE term <> '' GROUP BY 1
),
voc AS (SELECT 'tag' AS kind, term FROM tag_vocab UNION ALL SELECT 'class', term FROM class_vocab),
grams AS (
  SELECT kind, term, substring(w, i, n) AS ngram
  FROM (SELECT kind, term, '<' || term || '>' AS w FROM voc) v,
       range({C.NGRAM_MIN}, {C.NGRAM_MAX + 1}) r(n), range(1, length(v.w) - r.n + 2) q(i)
  WHERE length(v.w) >= r.n
),
hv AS (
  SELECT kind, term, d AS dim,
         avg(CAST(('0x' || substr(md5(ngram || '#' || CAST(d AS VARCHAR)), 1, 7)) AS BIGINT) / {float(0xFFFFFFF)!r}
             * (2.0 / {C.EMBED_DIM}) - (1.0 / {C.EMBED_DIM})) AS value
  FROM grams, range(0, {C.EMBED_DIM}) t(d) GROUP BY kind, term, d
)
"""


def with_all(select: str) -> str:
    return "WITH RECURSIVE " + BASE.strip() + ",\n" + VOCAB.strip() + "\n" + select


RULE = ("CASE WHEN length(content) <= {lo} THEN 0 "
        "WHEN NOT regexp_matches(content, '{cjk}') AND length(content) > {lat} THEN 1 "
        "WHEN regexp_matches(content, '{cjk}') AND length(content) > {han} THEN 1 ELSE {model} END")


def rule(model: str) -> str:
    return RULE.format(lo=C.RULE_MIN_LEN, lat=C.RULE_MAX_LEN_LATIN, han=C.RULE_MAX_LEN_CJK, cjk=CJK_RE, model=model)


NE = "(SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS BIGINT) AS idx, " \
     f"least(depth, {C.MAX_STEPS}) AS kept FROM nd WHERE content <> '')"

FOLDS = f"""(SELECT l.*, CAST((row_number() OVER (PARTITION BY label ORDER BY
              md5(concat_ws('#', '{C.FOLD_SEED}', CAST(page_id AS VARCHAR), CAST(pos AS VARCHAR))), page_id, pos) - 1)
              % {C.N_FOLDS} AS BIGINT) AS fold FROM lab l)"""

WEIGHTS = f"""(SELECT fold, CAST(tp - p AS BIGINT) AS n_pos, CAST((tn - n) - (tp - p) AS BIGINT) AS n_neg,
          CAST((tn - n) - (tp - p) AS DOUBLE) / NULLIF(tn - n, 0) AS pos_weight
   FROM (SELECT fold, sum(label) AS p, count(*) AS n FROM {FOLDS} GROUP BY fold) a,
        (SELECT sum(label) AS tp, count(*) AS tn FROM {FOLDS}) b)"""

PARAMS = f"""(SELECT sl / (n * t) AS ml, sqrt(greatest(sl2 / (n * t) - (sl / (n * t)) ^ 2, 0)) AS sdl,
          sp / (n * t) AS mp, sqrt(greatest(sp2 / (n * t) - (sp / (n * t)) ^ 2, 0)) AS sdp, n, t
   FROM (SELECT count(*)::DOUBLE AS n, max(e.kept)::DOUBLE AS t,
                sum(e.kept * f.text_len::DOUBLE) AS sl, sum(e.kept * f.text_len::DOUBLE * f.text_len) AS sl2,
                sum(e.kept * f.punct::DOUBLE) AS sp, sum(e.kept * f.punct::DOUBLE * f.punct) AS sp2
         FROM {NE} e JOIN pf f USING (page_id)))"""

SELECTS = {
    "page_clean_len": "SELECT page_id, CAST(length(html) AS BIGINT) AS n FROM cls",
    "page_gate": "SELECT page_id, visible_len, status FROM cls",
    "quarantine": "SELECT page_id, url, status AS reason FROM cls WHERE status <> 'ok'",
    "tag_vocab": "SELECT term, pages, uses FROM tag_vocab",
    "class_vocab": "SELECT term, uses FROM class_vocab",
    "raw_tokens": f"""SELECT page_id,
        CAST(len(list_filter(toks, lambda x: regexp_full_match(x, {lit(f'{START}|{END}')}))) AS BIGINT) AS n_tags,
        CAST(len(list_filter(toks, lambda x: NOT regexp_full_match(x, {lit(TAG_OR_DECL)}))) AS BIGINT) AS n_text
        FROM (SELECT page_id, regexp_extract_all(html, {lit(TOKEN)}) AS toks FROM cls)""",
    "events": "SELECT page_id, CAST(pos AS BIGINT) AS pos, kind, name, path FROM npath",
    "parents": """SELECT i.page_id, CAST(i.pos AS BIGINT) AS pos,
        CAST((SELECT max(j.pos) FROM nx j WHERE j.page_id = i.page_id AND j.pos < i.pos
               AND j.tag = i.an[-1] AND j.an = i.an[:len(i.an) - 1]) AS BIGINT) AS parent_pos
        FROM nx i""",
    "node_content": "SELECT page_id, CAST(pos AS BIGINT) AS pos, content FROM nd",
    "parents_search": None,
    "nonempty_nodes": f"SELECT page_id, CAST(pos AS BIGINT) AS pos, idx, CAST(length(content) AS BIGINT) AS n FROM {NE}",
    "closure": f"""SELECT page_id, CAST(pos AS BIGINT) AS pos, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS step,
        CAST(unnest(p) AS BIGINT) AS anc_pos FROM (SELECT page_id, pos, list_append(anc_pos, pos) AS p FROM {NE})""",
    "truncated_paths": f"SELECT page_id, CAST(pos AS BIGINT) AS pos, CAST(depth AS BIGINT) AS depth, CAST(kept AS BIGINT) AS kept FROM {NE}",
    "max_depth": f"SELECT page_id, CAST(max(kept) AS BIGINT) AS d FROM {NE} GROUP BY page_id",
    "page_features": "SELECT page_id, text_len, punct FROM pf",
    "node_features": "SELECT n.page_id, CAST(n.pos AS BIGINT) AS pos, n.tag, n.class_name, f.text_len, f.punct FROM nd n JOIN pf f USING (page_id)",
    "page_gold": """SELECT d.page_id, d.doc_id, g.lang, CAST(length(g.text) AS BIGINT) AS gold_len
        FROM pdoc d JOIN documents g ON g.doc_id = d.doc_id""",
    "gold_missing": "SELECT d.page_id FROM pdoc d WHERE NOT EXISTS (SELECT 1 FROM documents g WHERE g.doc_id = d.doc_id)",
    "labels": "SELECT page_id, CAST(pos AS BIGINT) AS pos, CAST(label AS BIGINT) AS label FROM lab",
    "label_rate_by_lang": "SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS pos FROM lab GROUP BY lang",
    "folds": f"SELECT page_id, CAST(pos AS BIGINT) AS pos, CAST(label AS BIGINT) AS label, fold FROM {FOLDS}",
    "fold_weights": f"SELECT CAST(fold AS BIGINT) AS fold, n_pos, n_neg, round(pos_weight, 6) AS pos_weight FROM {WEIGHTS}",
    "hash_vectors": "SELECT kind, term, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value FROM hv",
    "minmax_vectors": """SELECT kind, term, CAST(dim AS BIGINT) AS dim,
        round(coalesce((value - lo) / NULLIF(hi - lo, 0), 0), 6) AS value
        FROM (SELECT *, min(value) OVER (PARTITION BY kind, term) AS lo, max(value) OVER (PARTITION BY kind, term) AS hi FROM hv)""",
    "vocab_misses": """SELECT DISTINCT 'tag' AS kind, tag AS term FROM nd WHERE tag NOT IN (SELECT term FROM tag_vocab)
        UNION ALL
        SELECT DISTINCT 'class', class_name FROM nd WHERE class_name <> '' AND class_name NOT IN (SELECT term FROM class_vocab)""",
    "norm_params": f"""SELECT round(ml, 6) AS text_length_mean, round(sdl, 6) AS text_length_std,
        round(mp, 6) AS punctuation_nb_mean, round(sdp, 6) AS punctuation_nb_std,
        CAST(n AS BIGINT) AS n_nodes, CAST(t AS BIGINT) AS t_steps FROM {PARAMS}""",
    "zscores": f"""SELECT e.page_id, CAST(e.pos AS BIGINT) AS pos, CAST(s.step AS BIGINT) AS step,
        round((f.text_len - p.ml) / CASE WHEN p.sdl > 0 THEN p.sdl ELSE 1 END, 6) AS zl,
        round((f.punct - p.mp) / CASE WHEN p.sdp > 0 THEN p.sdp ELSE 1 END, 6) AS zp
        FROM {NE} e JOIN pf f USING (page_id), {PARAMS} p, range(0, e.kept) s(step)""",
    "length_rules": f"SELECT page_id, CAST(pos AS BIGINT) AS pos, CAST({rule('NULL')} AS BIGINT) AS decision FROM {NE}",
    "script_family": f"""SELECT page_id, CASE WHEN bool_or(regexp_matches(content, '{CJK_RE}')) THEN 'zh' ELSE 'la' END AS script
        FROM nd GROUP BY page_id""",
    "rule_f1": f"""SELECT lang, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1
        FROM (SELECT lang, sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
                     sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
                     sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn
              FROM (SELECT lang, label, {rule('0')} AS pred FROM lab) GROUP BY ROLLUP (lang))""",
    "rule_loss": f"""SELECT CAST(f.fold AS BIGINT) AS fold, round(avg(-(w.pos_weight * f.label * ln(f.p) + (1 - f.label) * ln(1 - f.p))), 6) AS loss
        FROM (SELECT fold, label, CASE {rule('NULL')} WHEN 1 THEN 0.99 WHEN 0 THEN 0.01 ELSE 0.5 END AS p FROM {FOLDS}) f
        JOIN {WEIGHTS} w USING (fold) GROUP BY f.fold""",
    "rule_bodies": f"""SELECT page_id, regexp_replace(coalesce(string_agg(CASE WHEN {rule('0')} = 1 THEN content END, '' ORDER BY pos), ''),
        '<[^>]+>', '', 'g') AS body FROM nd WHERE content <> '' GROUP BY page_id""",
}

# -- model vectors ---------------------------------------------------------------
# every kept step of a node's path with its terms, and the terms' vectors
STEPS = f""",
ne AS {NE},
st AS (SELECT e.page_id, e.pos, s.k - 1 AS k, a.tag, a.class_name
       FROM (SELECT page_id, pos, list_append(anc_pos, pos)[:{C.MAX_STEPS}] AS p FROM ne) e, range(1, len(e.p) + 1) s(k)
       JOIN nd a ON a.page_id = e.page_id AND a.pos = e.p[s.k]),
used AS (SELECT DISTINCT 'tag' AS kind, tag AS term FROM st UNION ALL SELECT DISTINCT 'class', class_name FROM st),
ug AS (SELECT kind, term, substring(w, i, n) AS ngram FROM (SELECT kind, term, '<' || term || '>' AS w FROM used) v,
              range({C.NGRAM_MIN}, {C.NGRAM_MAX + 1}) r(n), range(1, length(v.w) - r.n + 2) q(i) WHERE length(v.w) >= r.n),
uv AS (SELECT u.kind, u.term, d AS dim,
              coalesce(avg(CAST(('0x' || substr(md5(ngram || '#' || CAST(d AS VARCHAR)), 1, 7)) AS BIGINT) / {float(0xFFFFFFF)!r}
                           * (2.0 / {C.EMBED_DIM}) - (1.0 / {C.EMBED_DIM})), 0) AS value
       FROM used u CROSS JOIN range(0, {C.EMBED_DIM}) t(d) LEFT JOIN ug g ON g.kind = u.kind AND g.term = u.term GROUP BY u.kind, u.term, d),
sv AS (SELECT kind, term, dim, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM uv WINDOW w AS (PARTITION BY kind, term)),
-- a term's part of the product with the fixed weights ((62 k + place) * 7 mod 11 - 5) / 10 at step k
dots AS (SELECT kind, term, k, sum(coalesce((value - lo) / NULLIF(hi - lo, 0), 0)
                                   * ((({C.STEP_WIDTH} * k + dim + CASE kind WHEN 'tag' THEN 0 ELSE {C.EMBED_DIM} END) * 7 % 11 - 5) / 10.0)) AS dot
         FROM sv, range(0, {C.MAX_STEPS}) s(k) GROUP BY kind, term, k),
xs AS (SELECT st.page_id, st.pos, sum(t.dot) AS tags, sum(c.dot) AS classes FROM st
       JOIN dots t ON t.kind = 'tag' AND t.term = st.tag AND t.k = st.k
       JOIN dots c ON c.kind = 'class' AND c.term = st.class_name AND c.k = st.k GROUP BY st.page_id, st.pos),
zs AS (SELECT e.page_id, e.pos, e.content,
              sum((CASE WHEN k < e.kept THEN f.text_len ELSE 0 END - p.ml) / CASE WHEN p.sdl > 0 THEN p.sdl ELSE 1 END
                  * ((({C.STEP_WIDTH} * k + {2 * C.EMBED_DIM}) * 7 % 11 - 5) / 10.0)
                + (CASE WHEN k < e.kept THEN f.punct ELSE 0 END - p.mp) / CASE WHEN p.sdp > 0 THEN p.sdp ELSE 1 END
                  * ((({C.STEP_WIDTH} * k + {2 * C.EMBED_DIM + 1}) * 7 % 11 - 5) / 10.0)) AS numbers
       FROM ne e JOIN pf f USING (page_id), {PARAMS} p, range(0, {C.MAX_STEPS}) s(k) GROUP BY ALL)
"""
MODEL_SELECTS = {
    "term_vectors": """SELECT kind, term, CAST(dim AS BIGINT) AS dim, round(CASE WHEN EXISTS (SELECT 1 FROM voc WHERE voc.kind = sv.kind AND voc.term = sv.term)
        THEN coalesce((value - lo) / NULLIF(hi - lo, 0), 0) ELSE value END, 6) AS value FROM sv""",
    "step_vectors": """SELECT kind, term, CAST(dim AS BIGINT) AS dim, round(coalesce((value - lo) / NULLIF(hi - lo, 0), 0), 6) AS value FROM sv""",
    "path_vectors": """SELECT page_id, CAST(pos AS BIGINT) AS pos, round(tags, 6) AS tags, round(classes, 6) AS classes, round(numbers, 6) AS numbers
        FROM xs JOIN zs USING (page_id, pos)""",
    "path_scores": f"""SELECT page_id, CAST(pos AS BIGINT) AS pos, round(prob, 6) AS prob, CAST(pred AS BIGINT) AS pred, CAST({rule('pred')} AS BIGINT) AS accept
        FROM (SELECT *, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred
              FROM (SELECT page_id, pos, content, 1 / (1 + exp(-(0.25 + tags + classes + numbers))) AS prob FROM xs JOIN zs USING (page_id, pos)))""",
}

SELECTS |= {
    "fold_report": f"""SELECT fold, round(avg(tl), 6) AS train_loss, round(avg(vl), 6) AS val_loss, round(avg(f1), 6) AS f1,
            round(avg(pos_weight), 6) AS pos_weight, CAST(sum(n) AS BIGINT) AS n_val
        FROM (SELECT w.fold, w.pos_weight, avg(l) FILTER (f.fold <> w.fold) AS tl, avg(l) FILTER (f.fold = w.fold) AS vl, count(*) FILTER (f.fold = w.fold) AS n,
                     coalesce(2.0 * count(*) FILTER (f.fold = w.fold AND label = 1 AND p > 0.5)
                              / NULLIF(count(*) FILTER (f.fold = w.fold AND label = 1) + count(*) FILTER (f.fold = w.fold AND p > 0.5), 0), 0) AS f1
              FROM (SELECT fold, label, CASE {rule('NULL')} WHEN 1 THEN 0.99 WHEN 0 THEN 0.01 ELSE 0.5 END AS p FROM {FOLDS}) f,
                   {WEIGHTS} w, LATERAL (SELECT -(w.pos_weight * f.label * ln(f.p) + (1 - f.label) * ln(1 - f.p)) AS l) GROUP BY w.fold, w.pos_weight)
        GROUP BY ROLLUP (fold)""",
    "page_folds": f"""SELECT page_id, n_pos, n_rows, CAST((rank + rank // {C.N_FOLDS}) % {C.N_FOLDS} AS BIGINT) AS fold
        FROM (SELECT page_id, CAST(sum(label) AS BIGINT) AS n_pos, count(*) AS n_rows,
                     row_number() OVER (ORDER BY sum(label), CASE WHEN sum(label) % 2 = 0 THEN count(*) ELSE -count(*) END, md5('{C.FOLD_SEED}#' || page_id), page_id) - 1 AS rank
              FROM lab GROUP BY page_id)""",
    "gold_lines": "SELECT CAST(doc_id AS VARCHAR) AS filename, text AS body_text, 'first' AS website FROM documents",
    "vectors_csv": """SELECT kind, term, CAST(dim AS BIGINT) AS dim, round(coalesce((value - lo) / NULLIF(hi - lo, 0), 0), 6) AS value
        FROM (SELECT *, min(value) OVER (PARTITION BY kind, term) AS lo, max(value) OVER (PARTITION BY kind, term) AS hi FROM hv)
        UNION ALL SELECT 'class', '0', d, 0 FROM range(0, 30) t(d)""",
}

# the queries over changed pages: the same SQL over another table of pages
EDGES = {"edge_" + name: name for name in ("quarantine", "gold_missing", "class_vocab", "script_family", "length_rules")}
EDGE_PAGES = """edge_pages AS (
  SELECT page_id, CASE WHEN page_id % 6 = 4 THEN 'http://x.example/en/9' || (page_id + 1000000) ELSE url END AS url,
         CASE page_id % 6 WHEN 0 THEN substring(html, 1, 80) WHEN 1 THEN replace(html, '<html', '<div') WHEN 2 THEN replace(html, 'the', '中文')
                          WHEN 3 THEN replace(html, '<p>', '<p title="x > y" class=''k' || (page_id % 5) || '  b''>') WHEN 4 THEN html END AS html
  FROM pages
),
"""

NX = """,
nx AS (SELECT n.page_id, n.pos, n.tag, list_select(p.tags, list_transform(n.anc_pos, lambda a: a + 1)) AS an
       FROM nd n JOIN ptags p USING (page_id))
"""


def oracle_queries() -> dict[str, str]:
    out = {}
    SELECTS["parents_search"] = SELECTS["parents"]  # same literal backward search
    for name, sel in SELECTS.items():
        if name in ("parents", "parents_search"):
            out[name] = "WITH RECURSIVE " + BASE.strip() + NX + sel
        else:
            out[name] = with_all(sel)
    for name, sel in MODEL_SELECTS.items():
        out[name] = with_all(STEPS + sel)
    for name, like in EDGES.items():
        out[name] = with_all(SELECTS[like]).replace("FROM pages", "FROM edge_pages").replace("WITH RECURSIVE ", "WITH RECURSIVE " + EDGE_PAGES, 1)
    return out
