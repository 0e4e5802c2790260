"""Personal data: high-recall span generators, boosted trees over format and context, calibrated thresholds.

All of it is a projection of the documents: matches come from regular expressions, their places
from the lengths of what lies between them, features from the match and its surroundings, and
the fitted trees are compiled into one SQL expression. No Python runs on the executors and
nothing is shuffled. The trees are fitted on the driver in numpy, on a bounded set of made-up
sentences (TRAIN_ROWS of them) whose features the same expressions compute; part of that set is
left out of the fit and gives the thresholds for each kind.

Base spans (strict formats) always stay. The method adds spans that no strict format covers:
e-mail addresses with written-out signs, telephone numbers without a country code, card numbers
in other groupings, addresses with guarded dots. An added span never overlaps a base one; of
overlapping proposals the best stays, and then the best of those that it leaves free (after ROUNDS
rounds of that, what is still open is settled from left to right, the better of two staying). A run
of digits that is too long for one number or that touches a base span is also proposed in pieces of
up to PIECES groups, from every group on; the trees score a piece like any other span. Spans are
held against each other in runs of NEAR neighbours, so that a text with very many stays linear.

Defined cases: null and empty text have no spans; places count code points; overlapping base
spans of different kinds all stay; of equal scores the earlier, then longer span stays; repeated
rows and null ids are documents of their own; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
#: The base formats with possessive repeats, so that long runs take linear time and no stack.
BASE = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
AT = r"(?:\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?|\x20at\x20|\x20@\x20|@)"
DOT = r"(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20|\.)"
DIGITS = r"(?<![0-9A-Za-z])[(+]?[0-9](?:[\x20().\-/_]{0,2}[0-9]){6,}+"
#: Generators of candidates: kind, pattern, cheap condition that every match needs.
GENERATORS = (
    ("email", rf"(?i)(?:\G|(?<!{LOCAL})){LOCAL}++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++", r"(?i)[\x20\[({]at[\x20\])}]|@"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[({]?\.[\])}]?\x20?[0-9]{1,3}){3}(?![0-9])", r"[0-9][\x20\[({]{0,2}\."),
    ("card", DIGITS, r"[0-9](?:[\x20().\-/_]{0,2}[0-9]){12}"),
    ("phone", DIGITS, r"[0-9](?:[\x20().\-/_]{0,2}[0-9]){6}"),
)
#: A piece of a run ends with a group; kinds that come in runs, with the digits of one number.
SEPARATOR = r"[\x20().\-/_]{1,2}"
PIECES = 6
LIMITS = {"card": (13, 19), "phone": (7, 15)}
#: Words before or after a span that speak for a kind (fixed values).
CONTEXT = {
    "email": r"(?i)mail|contact|write|schreib|correo|courriel|kontakt|address",
    "ip": r"(?i)\bip\b|host|server|addr|login|logged",
    "card": r"(?i)card|visa|master|amex|karte|carte|tarjeta|credit|kredit|payment|iban|account|konto",
    "phone": r"(?i)phone|tel|call|fax|mobil|cell|anruf|ruf|llam|appel|whatsapp|sms|number|nummer",
}
FEATURES = ("kind", "digits", "groups", "longest", "plus", "luhn", "marks", "brackets", "length", "dots", "tail", "before", "after", "other", "glued", "words")
TRAIN_ROWS = 6000
PLACED = 256
NEAR = 48
ROUNDS = 3
#: Groups before a piece that its context may need.
BEFORE = 20
TREES = 40
DEPTH = 3
RATE = 0.3
SEED = 11


def _quote(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def located(text: str, pattern: str, gate: str) -> str:
    """SQL: array of (s, e, m, b): start, end, match, 40 characters before it."""
    p = _quote(pattern)
    kind = "array<struct<s:int,e:int,m:string,b:string>>"
    zipped = f"arrays_zip(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1))"
    # matches are placed in runs of PLACED, and runs one after the other, so that lists are copied in short pieces only
    runs = f"transform(sequence(0, (size(z) - 1) div {PLACED}), i -> slice(z, i * {PLACED} + 1, {PLACED}))"
    within = f"""aggregate(r, named_struct('p', 0, 'o', cast(array() AS {kind})), (c, x) -> named_struct('p', c.p + length(x['1']) + coalesce(length(x['0']), 0),
        'o', CASE WHEN x['0'] IS NULL THEN c.o ELSE concat(c.o, array(named_struct('s', c.p + length(x['1']), 'e', c.p + length(x['1']) + length(x['0']), 'm', x['0'], 'b', right(x['1'], 40)))) END))"""
    shifted = "transform(k.o, y -> named_struct('s', y.s + d.p, 'e', y.e + d.p, 'm', y.m, 'b', y.b))"
    placed = f"aggregate(transform({runs}, r -> {within}), named_struct('p', 0, 'o', cast(array() AS array<{kind}>)), (d, k) -> named_struct('p', d.p + k.p, 'o', concat(d.o, array({shifted}))), d -> flatten(d.o))"
    return f"CASE WHEN {text} RLIKE {_quote(gate)} THEN element_at(transform(array({zipped}), z -> {placed}), 1) ELSE cast(array() AS {kind}) END"


def _valid(kind: str) -> str:
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(right(concat('0', ltrim('0', p)), 4) AS int), 999) <= 255)",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND luhn_check({digits})",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
    }[kind]


def _features(kind: str) -> str:
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    runs = "filter(split(x.m, '[^0-9]+'), r -> r <> '')"
    other = "|".join(f"(?:{CONTEXT[k].removeprefix('(?i)')})" for k in KINDS if k != kind)
    flag = lambda c: f"cast(coalesce({c}, false) AS double)"
    values = {
        "kind": f"double({KINDS.index(kind)})",
        "digits": f"double(length({digits}))",
        "groups": f"double(size({runs}))",
        "longest": f"double(coalesce(array_max(transform({runs}, r -> length(r))), 0))",
        "plus": flag("startswith(x.m, '+')"),
        "luhn": flag(f"length({digits}) BETWEEN 13 AND 19 AND luhn_check({digits})"),
        "marks": "double(length(regexp_replace(x.m, '[A-Za-z0-9]', '')))",
        "brackets": flag("x.m RLIKE '[\\\\[({]'"),
        "length": "double(length(x.m))",
        "dots": "double(length(regexp_replace(x.m, '[^.]', '')))",
        "tail": "double(length(regexp_extract(x.m, '([A-Za-z]*)$', 1)))",
        "before": flag(f"x.b RLIKE {_quote(CONTEXT[kind])}"),
        "after": flag(f"x.b RLIKE {_quote('[:=#]' + chr(92) + 's*$')}"),
        "other": flag(f"x.b RLIKE {_quote('(?i)' + other)}"),
        "glued": flag("x.b RLIKE '[A-Za-z0-9]$'"),
        "words": flag("x.m RLIKE '(?i)[ (\\\\[{](at|dot)[ )\\\\]}]'"),
    }
    return "array(" + ", ".join(values[f] for f in FEATURES) + ")"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _runs(spans: str, i: str = "") -> str:
    """SQL: spans (in order of their starts, or nearly so) in runs of NEAR: (lo, hi, o)."""
    at = f"CASE WHEN size({spans}) > 0 THEN sequence(0, (size({spans}) - 1) div {NEAR}) ELSE cast(array() AS array<int>) END"
    return f"transform({at}, i{i} -> " + _let(f"slice({spans}, i{i} * {NEAR} + 1, {NEAR})", f"o{i}", f"named_struct('lo', array_min(transform(o{i}, y -> y.s)), 'hi', array_max(transform(o{i}, y -> y.e)), 'o', o{i})") + ")"


def _beside(spans: str, others: str, test: str, out: str) -> str:
    """SQL: for each span x its ``out``, in which {hit} says whether one of ``others`` (runs) overlaps it and passes ``test`` (of x and b)."""
    near = f"flatten(transform(filter({others}, q -> q.lo < r.hi AND r.lo < q.hi), q -> q.o))"
    hit = f"exists(near, b -> b.s < x.e AND x.s < b.e AND {test})"
    return f"flatten(transform({_runs(spans)}, r -> {_let(near, 'near', f'transform(r.o, x -> {out.format(hit=hit)})')}))"


def _touching(spans: str) -> str:
    return _beside(spans, "base_runs", "true", "named_struct('s', x.s, 'e', x.e, 'm', x.m, 'b', x.b, 't', {hit})")


def _pieces(i: int, kind: str) -> str:
    """SQL: the shorter spans of generator i's runs that don't fit as they are, as (s, e, m, b)."""
    low, high = LIMITS[kind]
    digits = "length(regexp_replace({}, '[^0-9]', ''))"
    odd = f"filter(made_{i}, x -> x.t OR {digits.format('x.m')} > {high})"
    # a group is a number with what stands before it; a piece begins at one whose number may open with a sign
    groups = located("x.m", r"[(+]?[0-9]++", "[0-9]")
    part = "concat_ws('', transform(slice(g, p + 1, k + 1), (y, n) -> concat(CASE WHEN n > 0 THEN y.b ELSE '' END, y.m)))"
    before = f"right(concat(x.b, concat_ws('', transform(slice(g, greatest(1, p + 1 - {BEFORE}), least(p, {BEFORE})), y -> concat(y.b, y.m))), g[p].b), 40)"
    made = _let(part, "m", "named_struct('s', x.s + g[p].s, 'e', x.s + g[p + k].e, 'm', m, 'b', h)")
    fits = f"filter(transform(sequence(0, least({PIECES - 1}, size(g) - 1 - p)), k -> {made}), y -> y.m <> x.m AND {digits.format('y.m')} BETWEEN {low} AND {high} AND y.m RLIKE {_quote('^[(+]?[0-9]++(?:' + SEPARATOR + '[0-9]++)*$')})"
    return f"flatten(flatten(transform({odd}, x -> {_let(groups, 'g', f'transform(sequence(0, size(g) - 1), p -> {_let(before, "h", fits)})')})))"


def candidates(df: DataFrame, text: str = "text", pieces: bool = True) -> DataFrame:
    """Adds base_<kind> (arrays of places) and candidates (array of kind, s, e, f: features)."""
    base = {f"base_{k}": F.expr(located(f"`{text}`", *BASE[k])) for k in KINDS}
    made = {f"made_{i}": F.expr(located(f"`{text}`", p, gate)) for i, (_, p, gate) in enumerate(GENERATORS)}
    df = df.withColumns(base | made)
    valid = {f"base_{k}": F.expr(f"filter(base_{k}, x -> {_valid(k)})") for k in KINDS}
    df = df.withColumns(valid)
    spans = "concat(" + ", ".join(f"transform(base_{k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, k in enumerate(KINDS)) + ")"
    df = df.withColumn("base", F.expr(f"array_sort({spans})")).withColumn("base_runs", F.expr(_runs("base")))
    none = "cast(array() AS array<struct<s:int,e:int,m:string,b:string,t:boolean>>)"
    df = df.withColumns({f"made_{i}": F.expr(f"CASE WHEN size(made_{i}) > 0 THEN {_touching(f'made_{i}')} ELSE {none} END") for i in range(len(GENERATORS))})
    if pieces:
        df = df.withColumns({f"part_{i}": F.expr(f"CASE WHEN size(made_{i}) > 0 THEN {_pieces(i, k)} ELSE cast(array() AS array<struct<s:int,e:int,m:string,b:string>>) END") for i, (k, _, _) in enumerate(GENERATORS) if k in LIMITS})
        df = df.withColumns({f"made_{i}": F.expr(f"CASE WHEN size(part_{i}) > 0 THEN concat(made_{i}, {_touching(f'part_{i}')}) ELSE made_{i} END") for i, (k, _, _) in enumerate(GENERATORS) if k in LIMITS})
    each = [f"transform(filter(made_{i}, x -> NOT x.t), x -> named_struct('k', {KINDS.index(k)}, 's', x.s, 'e', x.e, 'f', {_features(k)}))" for i, (k, _, _) in enumerate(GENERATORS)]
    df = df.withColumn("candidates", F.expr("concat(" + ", ".join(each) + ")"))
    return df.drop(*made, "base_runs", *(f"part_{i}" for i in range(len(GENERATORS))))


def example(rng: np.random.Generator) -> tuple[str, int]:
    """A made-up sentence with one span that a generator finds, and whether it is personal data."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    digits = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    letters = lambda a, b: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(a, b))))
    kind, yes = pick("email", "ip", "card", "phone"), bool(rng.integers(2))
    noise = " ".join(letters(2, 9) for _ in range(int(rng.integers(2, 7))))
    if kind == "email":
        at, dot = pick(("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" at ", " dot "), ("{at}", "{dot}"), (" @ ", "."), ("[at]", "."))
        if yes:
            span = f"{letters(3, 9)}{pick('', '.', '_')}{letters(0, 5)}{at}{letters(3, 10)}{dot}{pick('com', 'org', 'net', 'de', 'io')}"
            text = f"{noise} {pick('mail', 'contact', 'write to', 'e-mail:', '', '')} {span}"
        else:
            text = f"{noise} {letters(3, 9)} at {letters(2, 9)}.{letters(3, 11)}"
    elif kind == "ip":
        if yes:
            gap = pick("[.]", "(.)", " . ", "{.}")
            text = f"{noise} {pick('host', 'ip', 'server', '')} {gap.join(str(int(x)) for x in rng.integers(1, 256, 4))}"
        else:
            text = f"{noise} {pick('version', 'section', 'v', '')} {'.'.join(str(int(x)) for x in rng.integers(256, 999, 4))}" if rng.integers(2) else f"{noise} {'. '.join(str(int(x)) for x in rng.integers(1, 99, 4))}"
    elif kind == "card":
        d = digits(15)
        if yes:
            s = sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(d)))
            d += str(-s % 10)
            gap = pick(".", "/", "_", "  ")
            text = f"{noise} {pick('card', 'visa', 'payment', 'card number:', '')} {gap.join(d[i : i + 4] for i in range(0, 16, 4))}"
        else:
            d += digits(1)
            gap = pick("", "", "", "-", ".", "/")
            text = f"{noise} {pick('order', 'id', 'serial', '', '')} {gap.join(d[i : i + 4] for i in range(0, 16, 4))}"
    elif yes:
        span = pick(f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(3)}/{digits(7)}", f"00{digits(2)} {digits(3)} {digits(7)}", f"0{digits(3)} {digits(3)} {digits(4)}")
        text = f"{noise} {pick('phone', 'tel.', 'call', 'fax:', 'mobile', '', '')} {span}"
    else:
        span = pick(digits(16), digits(8), digits(10), digits(12), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(4)}-{digits(4)}", f"{digits(1)}.{digits(1)}.{digits(2)}.{digits(4)}.{digits(2)}", " ".join(digits(2) for _ in range(int(rng.integers(4, 9)))))
        text = f"{noise} {pick('order', 'isbn', 'date', 'id', '', '', '')} {span}"
    return f"{text} {noise}", int(yes)


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple:
    """A regression tree for gradients: (feature, cut, left, right), or a leaf's value."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 20:
        return (leaf,)
    best, base = None, g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if len(cut):
            gain = cg[cut] ** 2 / (ch[cut] + 1) + (cg[-1] - cg[cut]) ** 2 / (ch[-1] - ch[cut] + 1) - base
            i = int(gain.argmax())
            if gain[i] > 1e-6 and (best is None or gain[i] > best[0] + 1e-12):
                best = (gain[i], f, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    if best is None:
        return (leaf,)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[left], g[left], h[left], depth - 1), grow(x[~left], g[~left], h[~left], depth - 1))


def value(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], value(tree[2], x), value(tree[3], x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> list[tuple]:
    z, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        tree = grow(x, p - y, p * (1 - p), depth)
        out.append(tree)
        z += rate * value(tree, x)
    return out


def compiled(trees: list[tuple], x: str, rate: float = RATE) -> str:
    """SQL for the sum of the trees over the feature array ``x``."""

    def one(t: tuple) -> str:
        return f"{t[0] * rate:.10f}D" if len(t) == 1 else f"CASE WHEN {x}[{t[0]}] <= {t[1]:.6f}D THEN {one(t[2])} ELSE {one(t[3])} END"

    return " + ".join(f"({one(t)})" for t in trees)


def thresholds(z: np.ndarray, y: np.ndarray, kinds: np.ndarray, precision: float = 0.99) -> list[float]:
    """For each kind the lowest logit (0 at least) from which the left-out rows keep the precision."""
    out = []
    for k in range(len(KINDS)):
        own = kinds == k
        order = np.argsort(-z[own])
        s, t = z[own][order], y[own][order]
        good = np.flatnonzero(np.cumsum(t) / (np.arange(len(t)) + 1) >= precision) if len(t) else []
        out.append(max(0.0, float(s[good[-1]]) - 1e-9) if len(good) else float("inf"))
    return out


@lru_cache(maxsize=1)
def _examples(rows: int, seed: int) -> tuple:
    rng = np.random.default_rng(seed)
    return tuple(example(rng) for _ in range(rows))


_MODELS: dict[tuple, tuple[list[tuple], list[float]]] = {}


def model(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = SEED) -> tuple[list[tuple], list[float]]:
    """Trees and thresholds; the same for the same parameters, so kept for the process."""
    if (rows, seed) not in _MODELS:
        made = [(i, t, y) for i, (t, y) in enumerate(_examples(rows, seed))]
        found = candidates(spark.createDataFrame(made, "i int, text string, y int"), pieces=False).select("i", "y", F.explode("candidates").alias("c")).select("i", "y", "c.k", "c.f").collect()
        found.sort(key=lambda r: (r["i"], r["k"], r["f"]))
        x = np.array([r["f"] for r in found])
        # a proposal of the wrong kind is no personal data of that kind, unless no other fits
        y, k, i = (np.array([r[n] for r in found]) for n in ("y", "k", "i"))
        y = np.where((k == 2) & (x[:, FEATURES.index("luhn")] == 0), 0, y)
        y = np.where((k == 3) & (x[:, FEATURES.index("digits")] > 15), 0, y)
        fit = i % 4 != 0
        trees = boost(x[fit], y[fit])
        z = RATE * sum(value(t, x) for t in trees)
        _MODELS[rows, seed] = trees, thresholds(z[~fit], y[~fit], k[~fit])
    return _MODELS[rows, seed]


SPAN = "array<struct<s:int,k:int,e:int>>"
ONE = "struct<s:int,e:int,k:int,o:struct<w:int,z:double,s:int,n:int,k:int>>"
PASSED = f"array<{ONE}>"
_MARKED = "named_struct('s', x.s, 'e', x.e, 'k', x.k, 'o', x.o, 't', {hit})"
#: What is left of ``passed``, from left to right: the last span so far meets the next one.
_STEP = f"""CASE WHEN c.l IS NULL THEN named_struct('l', x, 'o', c.o) WHEN x.s < c.l.e THEN named_struct('l', CASE WHEN x.o < c.l.o THEN x ELSE c.l END, 'o', c.o)
    ELSE named_struct('l', x, 'o', concat(c.o, array(c.l))) END"""
_SWEEP = f"""aggregate({_runs('passed')}, named_struct('l', cast(null AS {ONE}), 'o', cast(array() AS array<{PASSED}>)), (d, r) ->
    {_let(f"aggregate(r.o, named_struct('l', d.l, 'o', cast(array() AS {PASSED})), (c, x) -> {_STEP})", 'k', "named_struct('l', k.l, 'o', concat(d.o, array(k.o)))")},
    d -> CASE WHEN d.l IS NULL THEN flatten(d.o) ELSE concat(flatten(d.o), array(d.l)) END)"""
_SWEPT = f"CASE WHEN size(passed) > 0 THEN transform({_SWEEP}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e)) ELSE cast(array() AS {SPAN}) END"


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, base, spans): arrays of (s, k, e), kind k as in KINDS; spans holds base ones and added ones."""
    trees, cuts = model(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("text"))
    df = candidates(rows)
    cut = "CASE c.k " + " ".join(f"WHEN {k} THEN {c:.9f}D" if np.isfinite(c) else f"WHEN {k} THEN double('Infinity')" for k, c in enumerate(cuts)) + " END"
    # a number in the strict form that a longer base match has swallowed stays, as base spans do, and goes before its own parts
    strict = f"CASE WHEN c.k = {KINDS.index('phone')} AND c.f[{FEATURES.index('plus')}] = 1 AND c.f[{FEATURES.index('digits')}] BETWEEN 10 AND 15 OR c.k = {KINDS.index('card')} AND c.f[{FEATURES.index('luhn')}] = 1 AND c.f[{FEATURES.index('groups')}] = 1 AND c.f[{FEATURES.index('digits')}] >= 14 THEN 0 ELSE 1 END"
    scored = F.expr(f"transform(candidates, c -> named_struct('z', {compiled(trees, 'c.f')}, 'w', {strict}, 'n', c.s - c.e, 's', c.s, 'k', c.k, 'e', c.e, 'cut', {cut}))")
    df = df.withColumn("scored", F.when(F.size("candidates") > 0, scored).otherwise(F.expr("cast(array() AS array<struct<z:double,w:int,n:int,s:int,k:int,e:int,cut:double>>)")))
    df = df.withColumn("passed", F.expr("filter(scored, c -> c.w = 0 OR c.z >= c.cut)"))
    some = "CASE WHEN size(passed) > 0 THEN {} ELSE cast(array() AS " + SPAN + ") END"
    df = df.withColumn("passed", F.expr(some.format("array_sort(transform(passed, c -> named_struct('s', c.s, 'e', c.e, 'k', c.k, 'o', named_struct('w', c.w, 'z', -c.z, 's', c.s, 'n', c.n, 'k', c.k))))").replace(SPAN, PASSED)))
    taken = []
    for i in range(ROUNDS):
        # the best among all that overlap them stay, what overlaps those goes, and the rest is looked at again
        df = df.withColumn("open_runs", F.expr(_runs("passed")))
        df = df.withColumn("best", F.expr(f"filter({_beside('passed', 'open_runs', 'b.o < x.o', _MARKED)}, x -> NOT x.t)")).withColumn("best_runs", F.expr(_runs("best")))
        df = df.withColumn(f"taken_{i}", F.expr(some.format("transform(best, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))")))
        df = df.withColumn("passed", F.expr(f"transform(filter({_beside('passed', 'best_runs', 'true', _MARKED)}, x -> NOT x.t), x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'o', x.o))"))
        taken.append(f"taken_{i}")
    df = df.withColumn("swept", F.expr(_SWEPT))
    return df.withColumn("spans", F.expr(f"array_sort(concat(base, {', '.join(taken)}, swept))")).select("doc_id", "text", *(f"base_{k}" for k in KINDS), "base", "spans")


def joined(col: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({col}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, redacted): every span replaced by its kind in square brackets; overlapping spans by the first."""
    out = spans(docs, id_col, text_col)
    names = "array(" + ", ".join(f"'[{k}]'" for k in KINDS) + ")"
    step = f"CASE WHEN x.s < c.p THEN c ELSE named_struct('p', x.e, 't', concat(c.t, substring(text, c.p + 1, x.s - c.p), {names}[x.k])) END"
    return out.select("doc_id", F.expr(f"aggregate(spans, named_struct('p', 0, 't', ''), (c, x) -> {step}, c -> concat(c.t, substring(text, c.p + 1)))").alias("redacted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans(table(spark, sf_dir, "documents"))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"))
