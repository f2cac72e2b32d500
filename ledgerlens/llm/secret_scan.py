"""Secret scan in DataFrame expressions only (no Python on the executors).

Three fixed patterns give the base spans.  Beside them, candidate strings are
judged by the Shannon entropy of a window that slides over their characters:
the counts of the window are kept in an array, a step adds the entering and
removes the leaving character, and the sum of c*log2(c) follows from those
two counts alone.  Thresholds depend on the candidate's character class; an
allow-list suppresses known harmless shapes.

Positions come from the pieces between the matches: a match ends where the
lengths of all pieces and matches up to it add up to.  Lengths are code
points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

# (kind, pattern, group whose length counts, least length)
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
# a pattern that must occur for the kind to have a kept match; it spares the full search elsewhere
HINT = {"assign": BASE[0][1], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

ALPHABET = "A-Za-z0-9+/_=-"
WINDOW = 20
# bits in some window; random text has about 3.4 (16 symbols) to 4.1 (64 symbols) in 20 characters
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.8}
ALLOW = [
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # UUID
    r"[0-9=_+/-]+",                        # figures, dates, rules
    r"[A-Za-z=_+/-]+",                     # words joined by punctuation
    r"(?i).*(example|placeholder|changeme|dummy|sample|xxxx).*",
    r"(?i)[a-z]+([_/-][a-z]+)*[_/-]?[0-9]{1,4}",  # numbered names
]
FIRST_CODE = 43  # '+', the smallest code of the alphabet
CODES = 80
MASK = "[SECRET]"
BLOCK = 256


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(df: DataFrame, lens: str, out: str) -> DataFrame:
    """``out``: inclusive running sums of the int array column ``lens``."""
    n = f"size({lens})"
    df = df.selectExpr("*", f"CASE WHEN {n} = 0 THEN CAST(array() AS ARRAY<ARRAY<INT>>) ELSE transform("
                            f"sequence(0, ({n} - 1) div {BLOCK}), b -> slice({lens}, b * {BLOCK} + 1, {BLOCK})) END AS _blocks")
    df = df.selectExpr("*", "aggregate(_blocks, array(0), (a, b) -> concat(a, array(element_at(a, -1)"
                            " + aggregate(b, 0, (s, x) -> s + x)))) AS _bases")
    return df.selectExpr("*", "flatten(transform(_blocks, (b, i) -> slice(aggregate(b, array(_bases[i]),"
                              f" (a, x) -> concat(a, array(element_at(a, -1) + x))), 2, size(b)))) AS {out}"
                         ).drop("_blocks", "_bases")


def _matches(df: DataFrame, kind: str, pattern: str, hint: str, group: int, least: int) -> DataFrame:
    """Adds ``_<kind>``: the kept matches as array<struct<start, end, text>>."""
    p, none = _lit(pattern), "CAST(array() AS ARRAY<STRING>)"
    hit = f"rlike(_text, {_lit(hint)})"
    df = df.selectExpr("*", f"{hit} AS _hit").selectExpr(
        "*", f"CASE WHEN _hit THEN regexp_extract_all(_text, {p}, 0) ELSE {none} END AS _m",
        f"CASE WHEN _hit THEN split(_text, {p}, -1) ELSE {none} END AS _p",
        *([f"CASE WHEN _hit THEN regexp_extract_all(_text, {p}, {group}) ELSE {none} END AS _g"] if group else []))
    df = df.selectExpr("*", "transform(_m, (m, i) -> length(m) + length(_p[i])) AS _l")
    df = _running(df, "_l", "_e")
    counted = "_g[i]" if group else "m"
    return df.selectExpr(
        "*", "filter(transform(_m, (m, i) -> named_struct('start', _e[i] - length(m), 'end', _e[i], 'text', m,"
             f" 'n', length({counted}))), x -> x.n >= {least}) AS _{kind}"
    ).drop("_hit", "_m", "_p", "_l", "_e", *(["_g"] if group else []))


def max_window_entropy(text: str, window: int = WINDOW) -> str:
    """SQL: the largest entropy, in bits, of ``window`` characters in a row
    of the string expression ``text`` (characters of the alphabet; shorter
    strings: 0)."""
    clog = ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(window + 2))
    f = f"array({clog})"
    code = f"(ascii(substring({text}, {{}}, 1)) - {FIRST_CODE})"
    into, out = code.format("i + 1"), code.format(f"greatest(i - {window} + 1, 1)")
    slides = f"i >= {window}"
    entered = f"a.s + {f}[a.c[{into}] + 1] - {f}[a.c[{into}]]"
    held = f"(a.c[{out}] + IF({out} = {into}, 1, 0))"
    s = f"({entered} + IF({slides}, {f}[greatest({held} - 1, 0)] - {f}[{held}], 0D))"
    counts = f"transform(a.c, (n, k) -> n + IF(k = {into}, 1, 0) - IF({slides} AND k = {out}, 1, 0))"
    return (f"aggregate(sequence(0, length({text}) - 1), named_struct('c', array_repeat(0, {CODES}), 's', 0D, 'm', 0D),"
            f" (a, i) -> named_struct('c', {counts}, 's', {s},"
            f" 'm', IF(i >= {window} - 1, greatest(a.m, {math.log2(window)!r}D - {s} / {window}), a.m)), a -> a.m)")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         thresholds: dict[str, float] | None = None, allow: list[str] | None = None) -> DataFrame:
    """``docs`` with a column ``secrets``: array<struct<start, rank, kind, end>>
    sorted by start, then kind as listed (assign, access, hex, entropy).

    Entropy spans are added unless they lie wholly inside a base span; they
    may overlap one (:func:`redact` masks what any of them covers).  Null and empty
    texts have no spans.  Other columns of the input are kept as they are
    (one named ``secrets`` is replaced); rows, repeated ones too, stay."""
    t = {**THRESHOLDS, **(thresholds or {})}
    cols = [c for c in docs.columns if c != "secrets"]
    df = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(cols)],
                     docs[text_col].alias("_text")).selectExpr("*", "coalesce(_text, '') AS _t").drop("_text") \
             .withColumnRenamed("_t", "_text")
    for kind, pattern, group, least in BASE:
        df = _matches(df, kind, pattern, HINT[kind], group, least)
    candidate = f"(?<![{ALPHABET}])[{ALPHABET}]{{{window},}}+"
    df = _matches(df, "candidate", candidate, candidate, 0, window)
    base = "concat(_assign, _access, _hex)"
    benign = " OR ".join(f"rlike(x.text, {_lit('^(?:' + a + ')$')})" for a in (ALLOW if allow is None else allow)) or "false"
    df = df.selectExpr("*", f"{base} AS _base")
    df = df.selectExpr("*", f"filter(_candidate, x -> NOT ({benign}) AND NOT exists(_base, y -> y.start <= x.start"
                            " AND x.end <= y.end)) AS _judged")
    level = (f"CASE WHEN rlike(x.text, '^[0-9a-fA-F]+$') THEN {t['hex']!r}D"
             f" WHEN rlike(x.text, '^[0-9a-zA-Z]+$') THEN {t['alnum']!r}D ELSE {t['base64']!r}D END")
    df = df.selectExpr("*", f"filter(_judged, x -> {max_window_entropy('x.text', window)} >= {level}) AS _entropy")
    spans = ", ".join(f"transform(_{kind}, x -> named_struct('start', x.start, 'rank', {rank}, 'kind', '{kind}', 'end', x.end))"
                      for rank, kind in enumerate(["assign", "access", "hex", "entropy"]))
    df = df.selectExpr(*[f"c{i}" for i in range(len(cols))], f"array_sort(concat({spans})) AS secrets")
    return df.toDF(*cols, "secrets")


def redact(scanned: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``scanned`` (with ``secrets``) with every span of the text replaced by
    ``mask`` (spans that touch or overlap give one) and ``secrets`` dropped."""
    merged = ("aggregate(secrets, CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>), (a, x) ->"
              " IF(size(a) > 0 AND element_at(a, -1).end >= x.start,"
              " concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start,"
              " 'end', greatest(element_at(a, -1).end, x.end)))),"
              " concat(a, array(named_struct('start', x.start, 'end', x.end)))))")
    cols = [c for c in scanned.columns if c != "secrets"]
    df = scanned.select(*[scanned[c].alias(f"c{i}") for i, c in enumerate(cols)], scanned["secrets"])
    text = f"c{cols.index(text_col)}"
    df = df.selectExpr("*", f"{merged} AS _cut").selectExpr(
        "*", f"CASE WHEN size(_cut) = 0 THEN {text} ELSE concat(array_join(transform(_cut, (x, i) -> concat(substring({text},"
             f" IF(i = 0, 0, _cut[greatest(i - 1, 0)].end) + 1, x.start - IF(i = 0, 0, _cut[greatest(i - 1, 0)].end)),"
             f" {_lit(mask)})), ''), substring({text}, element_at(_cut, -1).end + 1)) END AS _new")
    return df.selectExpr(*[f"_new AS c{i}" if c == text_col else f"c{i}" for i, c in enumerate(cols)]).toDF(*cols)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of scanned rows."""
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    count = "CAST(size(filter(secrets, x -> x.kind = '{0}')) AS BIGINT) AS n_{0}"
    return scanned.select(scanned[id_col].alias("doc_id"), "secrets").selectExpr(
        "doc_id", *[count.format(k) for k in ("assign", "access", "hex")],
        f"sha2({joined.format('filter(secrets, x -> x.rank < 3)')}, 256) AS base_sha256",
        f"{joined.format('secrets')} AS spans")
