"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Base spans come from fixed patterns and their checks and always stay. High-recall generators propose further,
overlapping candidates: numbers in any grouping and runs of digits within them, defanged addresses, mail addresses in words, long tokens of letters and
digits. Each has hidden evidence, which no feature shows: whether the normal form of a mail address, address or card
number passes its check; whether a plus stands before a telephone number; whether a word such as "token" assigns a
secret. Format and context features of a candidate make a small cell (FEATURES); one aggregate over all documents counts,
for every cell, candidates with and without the evidence. Boosted trees are fitted on these counts (their number is
bounded by the features' values, not by the input) against a uniform background, which stands for what the documents
happen not to hold, and become a CASE expression.

A threshold per kind is calibrated on a held-out part, from smoothed shares, so that it works at every size. Where the
evidence is a check that others pass by CHANCE, the share p of a region gives the precision (p - q) / (p (1 - q)) of what
passes; what fails is never added. Where the evidence is a mark that others may lack (plus, assignment), the region's
share is held against the best region's: candidates of regions like it are taken with or without the mark.

Rows never leave the JVM and are never exploded or shuffled on the main path: spans are arrays within the row. Work in a
row follows its length and its spans times the square root of their number: places are sums over blocks, texts are cut
from chunks. Candidates are looked for where base spans are blanked out, so none overlaps one.

Defined results: null texts are empty and have no spans. Positions are code points, the end is exclusive. Candidates
of one generator do not overlap; of two kinds that propose one number, each is judged on its own. Repeated rows repeat
their result; extra columns take no part, whatever their names.
"""

from __future__ import annotations

import math
import random
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The base patterns, in the form that Java walks without backtracking into a run (a run that fails from
# its start fails from every later start, and the end of the last match is a start of its own).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Generators of further candidates. They hold no line break, which is what blanks base spans out.
WIDE_EMAIL = r"(?<![^\s<>,;:\"()\[\]{}@])[^\s<>,;:\"()\[\]{}@]++(?:\x20?(?:@|[(\[{]at[)\]}])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[A-Za-z0-9-]++)*+|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)"
WIDE_IP = r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
WIDE_NUMBER = r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])"
LONG_NUMBER = r"(?<![0-9A-Za-z])[0-9]{13,19}+(?![0-9A-Za-z])"
WIDE_SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
# Evidence and checks.
AT, DOT = r"\x20?[(\[{]at[)\]}]\x20?|\x20at\x20|\x20?@\x20?", r"\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20|\[\.\]|\(\.\)|\x20?\.\x20?"
PLAIN_EMAIL = r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,12}$"
PLAIN_IP = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"
ASSIGNED = r"(?i)(?:token|key|secret|passw(?:or)?d|pwd|auth|bearer|credentials?)[\"'\x20]{0,2}[:=]?[\"'\x20]{0,3}$"

#: What the method finds beside the listed kinds.
SECRET = 4
FEATURES = ("kind", "digits", "groups", "sep", "before", "after", "cue", "size", "first", "mixed")
#: Values of each feature but the kind.
VALUES = (21, 5, 6, 3, 3, 2, 7, 5, 4)
CUES = r"(?i)(?:tel|phone|call|fax|mobile|card|visa|iban|account|mail|contact|host|server|addr)[a-z]*[^A-Za-z0-9]{0,3}$"
#: How often candidates of no worth pass the check of their kind.
CHANCE = {0: 0.05, 1: 0.1, 2: 0.1}
#: Background candidates of a kind, and their weight against those with evidence.
BACKGROUND, BACKGROUND_SHARE = 256, 0.1
#: Code points to a chunk of a text.
CHUNK = 4096
ROUNDS, RATE, DEPTH = 24, 0.4, 2
#: Precision at least above the threshold of a kind, and share of marked candidates in the best region of a kind with marks.
PRECISION, MARKED = 0.95, 0.5
BLOCK = 256
SPAN = "array<struct<start:int,end:int,kind:int,m:string>>"


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans of the leftmost non-overlapping matches. Starts are sums over blocks of BLOCK matches and within a block."""

    def spans(found: Column) -> Column:
        n = F.size(found)

        def placed(steps: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(steps, (b * BLOCK + 1).cast("int"), BLOCK), F.lit(0), lambda a, x: a + x))

            def starts(sums: Column) -> Column:
                heads = F.transform(sums, lambda _, i: F.aggregate(F.slice(sums, 1, i), F.lit(0), lambda a, x: a + x))
                return let(heads, lambda h: F.transform(found, lambda m, i: _span(h, m, i)))

            def _span(h: Column, m: Column, i: Column) -> Column:
                head = F.floor(i / BLOCK).cast("int")
                end = F.get(h, head) + F.aggregate(F.slice(steps, head * BLOCK + 1, i - head * BLOCK + 1), F.lit(0), lambda a, x: a + x)
                return F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), m.alias("m"))

            return let(blocks, starts)

        steps = F.transform(F.slice(F.split(text, pattern, -1), 1, n), lambda p, i: F.char_length(p) + F.char_length(F.get(found, i)))
        return F.when(n > 0, let(steps, placed)).otherwise(none())

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def none() -> Column:
    return F.array().cast(SPAN)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a digit string is a multiple of ten."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x: x.cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    digit = F.contains(text, F.lit("+")) | text.rlike("[0-9]")
    email = F.when(F.contains(text, F.lit("@")), matches(text, EMAIL, 0)).otherwise(none())
    part = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda x: (F.char_length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255))
    ip = F.filter(matches(text, IP, 1), lambda s: F.forall(F.split(s["m"], r"\."), part))
    card = F.filter(matches(text, CARD, 2), lambda s: let(digits_of(s["m"]), lambda d: F.when(F.char_length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))))
    phone = F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE, 3), lambda s: F.char_length(digits_of(s["m"])).between(10, 15))).otherwise(none())
    numbers = F.when(digit, F.concat(ip, card, phone)).otherwise(none())
    return F.array_sort(F.concat(email, numbers), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(chunks: Column, a: Column, b: Column) -> Column:
    """The text from code point a to before b; places outside it hold nothing."""
    i, j = (a / CHUNK).cast("int"), (b / CHUNK).cast("int")
    head = F.substring(F.get(chunks, i), a % CHUNK + 1, F.when(i == j, b - a).otherwise(F.lit(CHUNK)))
    middle = F.when(j > i + 1, F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(1))), ""))
    tail = F.when(j > i, F.substring(F.get(chunks, j), F.lit(1), b % CHUNK))
    return F.concat(*(F.coalesce(x, F.lit("")) for x in (head, middle, tail)))


def highest_before(ends: Column) -> Column:
    """Of bound values, the greatest of the values before each, 0 for the first: over blocks, then within a block."""
    most = lambda x: F.coalesce(F.array_max(x), F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(ends) - 1) / BLOCK).cast("int")), lambda b: most(F.slice(ends, b * BLOCK + 1, BLOCK)))
    heads = let(blocks, lambda x: F.transform(x, lambda _, i: most(F.slice(x, 1, i))))
    return let(heads, lambda h: F.transform(ends, lambda _, i: F.greatest(F.get(h, (i / BLOCK).cast("int")), most(F.slice(ends, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))))


def replaced(text: Column, spans: Column, new) -> Column:
    """The text with new(span, first code point not yet replaced) instead of each of the spans, sorted by start; of
    spans that lie within earlier ones nothing is left."""

    def joined(chunks: Column, ends: Column) -> Column:
        def pieces(done: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                d = F.get(done, i)
                return F.when(s["end"] <= d, F.lit("")).otherwise(F.concat(cut(chunks, d, F.greatest(s["start"], d)), new(s, F.greatest(s["start"], d))))

            return F.array_join(F.transform(spans, piece), "")

        return F.concat(let(highest_before(ends), pieces), cut(chunks, F.array_max(ends), F.char_length(text)))

    ends = F.transform(spans, lambda s: s["end"])
    return F.when(F.size(spans) > 0, let(chunks_of(text), lambda chunks: let(ends, lambda x: joined(chunks, x)))).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """The text with line breaks where spans are, so that places stay as they are."""
    return replaced(text, spans, lambda s, start: F.repeat(F.lit("\n"), s["end"] - start))


def candidates(text: Column) -> Column:
    """Spans that the generators propose; a number is a card candidate from 13 digits without brackets, else a telephone's."""
    has = lambda *parts: reduce(or_, (F.contains(text, F.lit(p)) for p in parts))
    digit = text.rlike("[0-9]")
    email = F.when(has("@", "at)", "at]", "at}", " dot "), matches(text, WIDE_EMAIL, 0)).otherwise(none())
    ip = F.when(digit, matches(text, WIDE_IP, 1)).otherwise(none())
    number = F.filter(matches(text, WIDE_NUMBER, 2), lambda s: F.char_length(digits_of(s["m"])).between(7, 19) & (s["m"].rlike("[^0-9]") | (F.char_length(s["m"]) < 13)))
    number = F.transform(number, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when((F.char_length(digits_of(s["m"])) >= 13) & ~s["m"].rlike(r"[()]"), 2).otherwise(3).alias("kind"), s["m"].alias("m")))
    secret = F.filter(matches(text, WIDE_SECRET, SECRET), lambda s: s["m"].rlike("[0-9]") & s["m"].rlike("[A-Za-z]"))
    return F.concat(email, ip, F.when(digit, F.concat(number, matches(text, LONG_NUMBER, 2), secret)).otherwise(none()))


def passes(s: Column) -> Column:
    """Whether a candidate could be what its kind says, by the check of its kind."""
    m = s["m"]
    return (
        F.when(s["kind"] == 0, F.regexp_replace(F.regexp_replace(m, AT, "@"), DOT, ".").rlike(PLAIN_EMAIL))
        .when(s["kind"] == 1, F.regexp_replace(m, DOT, ".").rlike(PLAIN_IP))
        .when(s["kind"] == 2, luhn(digits_of(m)))
        .when(s["kind"] == 3, F.char_length(digits_of(m)).between(10, 15))
        .otherwise(F.lit(True))
    )


def evidence(lead: Column, s: Column) -> Column:
    """What the features must not show; lead: the text just before."""
    return F.when(s["kind"] == 3, lead.endswith("+") & passes(s)).when(s["kind"] == SECRET, lead.rlike(ASSIGNED)).otherwise(passes(s))


def features(lead: Column, after: Column, s: Column) -> Column:
    """The cell of a candidate. Marks that are evidence are hidden: a plus before a number counts as white space, a
    country code does not count, nor do the separators of addresses or what assigns a secret."""

    def side(c: Column) -> Column:
        return F.when((c == "") | c.rlike(r"^[\s+]$"), 0).when(c.rlike(r"^[\p{L}0-9]$"), 1).otherwise(2)

    def made(body: Column) -> Column:
        digits = digits_of(body)
        number = (s["kind"] == 2) | (s["kind"] == 3)
        first = F.substring(digits, F.lit(1), F.lit(1))
        sep = F.when(body.rlike(r"[()]"), 5).when(body.rlike(r"\."), 4).when(body.rlike("/"), 3).when(body.rlike("-"), 2).when(body.rlike(r"\x20"), 1).otherwise(0)
        return F.struct(
            s["kind"].alias("kind"),
            F.when(s["kind"] == 1, 0).otherwise(F.least(F.char_length(digits), F.lit(20))).alias("digits"),
            F.when(number, F.least(F.size(F.regexp_extract_all(body, F.lit("[0-9]+"), F.lit(0))), F.lit(4))).otherwise(0).alias("groups"),
            F.when(number, sep).otherwise(0).alias("sep"),
            F.when(s["kind"] == SECRET, 0).otherwise(side(F.right(lead, F.lit(1)))).alias("before"),
            side(after).alias("after"),
            F.when(s["kind"] == SECRET, 0).otherwise(lead.rlike(CUES).cast("int")).alias("cue"),
            F.when(number | (s["kind"] == 1), 0).otherwise(F.least((F.char_length(body) / 8).cast("int"), F.lit(6))).alias("size"),
            F.when(s["kind"] == 2, F.when(first == "", 0).when(first < "3", 1).when(first == "3", 2).when(first < "7", 3).otherwise(4)).otherwise(0).alias("first"),
            F.when(s["kind"] == SECRET, F.when(body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 0).when(body.rlike("^[0-9A-Za-z]+$"), 1).when(body.rlike("[a-z]{8}"), 2).otherwise(3)).otherwise(0).alias("mixed"),
        )

    national = F.when(s["m"].rlike(r"^[0-9]{1,3}[\x20.-]"), F.regexp_replace(s["m"], r"^[0-9]{1,3}[\x20.-]+", "")).otherwise(s["m"])
    return let(F.when((s["kind"] == 3) & (F.char_length(digits_of(s["m"])) >= 11), national).otherwise(s["m"]), made)


def around(chunks: Column, s: Column, f) -> Column:
    """f of the text just before a span and of the code point after it."""
    return let(F.struct(cut(chunks, F.greatest(s["start"] - 24, F.lit(0)), s["start"]).alias("lead"), cut(chunks, s["end"], s["end"] + 1).alias("after")), lambda x: f(x["lead"], x["after"]))


def cells(docs: DataFrame) -> list[tuple]:
    """(features..., held out, with evidence, without) of every cell that occurs in all documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0).cast("int").alias("held"))
    rows = rows.select("text", "held", candidates(F.col("text")).alias("found")).where(F.size("found") > 0)
    made = let(chunks_of(F.col("text")), lambda chunks: F.transform("found", lambda s: around(chunks, s, lambda lead, after: F.struct(features(lead, after, s).alias("f"), evidence(lead, s).cast("int").alias("yes")))))
    flat = rows.select("held", F.explode(made).alias("c")).select("held", "c.f.*", "c.yes")
    counted = flat.groupBy(*FEATURES, "held").agg(F.sum("yes").alias("yes"), F.count("*").alias("n"))
    return sorted((*(r[f] for f in FEATURES), r["held"], r["yes"], r["n"] - r["yes"]) for r in counted.collect())


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit(table: list[tuple]) -> tuple[float, list, dict[int, float]]:
    """(offset, trees, threshold of each kind): logistic boosting on cell counts, thresholds from the held-out cells.

    A tree is (feature, cut, left, right) or a number; left holds values up to the cut.
    """
    k = len(FEATURES)
    train = [(r[:k], r[k + 1], r[k + 2]) for r in table if not r[k]]
    rng = random.Random(17)
    context = [FEATURES.index(f) - 1 for f in ("before", "after", "cue")]
    for kind in sorted({x[0] for x, _, _ in train}):
        seen = [(x, y + n) for x, y, n in train if x[0] == kind]
        weight = BACKGROUND_SHARE * (1 + sum(y for x, y, _ in train if x[0] == kind)) / BACKGROUND
        for (x, _) in rng.choices(seen, [n for _, n in seen], k=BACKGROUND):  # contexts as they occur, any format
            train.append(((kind, *(x[k + 1] if k in context else rng.randrange(v) for k, v in enumerate(VALUES))), 0, weight))
    yes, no = sum(r[1] for r in train), sum(r[2] for r in train)
    if not yes or not no:
        return 0.0, [], {}
    offset = math.log(yes / no)
    scores = [offset] * len(train)
    trees = []

    def grow(rows: list[int], grads: list[tuple[float, float]], depth: int):
        g, h = sum(grads[i][0] for i in rows), sum(grads[i][1] for i in rows)
        best = (1e-9, None)
        if depth:
            for f in range(k):
                by: dict[int, list[float]] = {}
                for i in rows:
                    x = by.setdefault(train[i][0][f], [0.0, 0.0])
                    x[0] += grads[i][0]
                    x[1] += grads[i][1]
                gl = hl = 0.0
                for cut in sorted(by)[:-1]:
                    gl, hl = gl + by[cut][0], hl + by[cut][1]
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, (f, cut))
        if best[1] is None:
            return RATE * g / (h + 1)
        f, cut = best[1]
        return (f, cut, grow([i for i in rows if train[i][0][f] <= cut], grads, depth - 1), grow([i for i in rows if train[i][0][f] > cut], grads, depth - 1))

    for _ in range(ROUNDS):
        grads = []
        for (_, y, n), s in zip(train, scores, strict=True):
            p = sigmoid(s)
            grads.append((y - (y + n) * p, (y + n) * p * (1 - p)))
        trees.append(grow(list(range(len(train))), grads, DEPTH))
        scores = [s + evaluate(trees[-1], r[0]) for r, s in zip(train, scores, strict=True)]
    thresholds = {}
    for kind in range(len(KINDS) + 1):
        held = sorted(((offset + sum(evaluate(t, r[:k]) for t in trees), r[k + 1], r[k + 2]) for r in table if r[k] and r[0] == kind), reverse=True)
        y = n = 0
        best = 0.0
        for place, (s, a, b) in enumerate(held):
            y, n = y + a, n + b
            if place + 1 < len(held) and held[place + 1][0] == s:
                continue
            share = y / (y + n + 1)  # smoothed: one candidate without evidence more than there are
            if kind in CHANCE:
                q = CHANCE[kind]
                good = share > q and (share - q) / (share * (1 - q)) >= PRECISION
            else:
                best = max(best, share)
                good = best >= MARKED and share >= PRECISION * best
            if good:
                thresholds[kind] = s
    return offset, trees, thresholds


def evaluate(tree, x: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def expression(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(f[FEATURES[tree[0]]] <= tree[1], expression(tree[2], f)).otherwise(expression(tree[3], f))


def selected(text: Column, base: Column, model: tuple) -> Column:
    """Candidates outside base spans that pass their check and whose score reaches their kind's threshold."""
    offset, trees, thresholds = model
    if not thresholds:
        return none()

    def score(f: Column) -> Column:
        total = F.lit(offset)
        for t in trees:
            total = total + expression(t, f)
        least = F.lit(math.inf)
        for kind, t in thresholds.items():
            least = F.when(f["kind"] == kind, F.lit(t - 1e-9)).otherwise(least)
        return total >= least

    def chosen(rest: Column) -> Column:
        def wanted(found: Column) -> Column:
            return let(chunks_of(rest), lambda chunks: F.filter(found, lambda s: passes(s) & around(chunks, s, lambda lead, after: let(features(lead, after, s), score))))

        return let(candidates(rest), lambda found: F.when(F.size(found) > 0, wanted(found)).otherwise(none()))

    return let(blanked(text, base), chosen)


def find(docs: DataFrame, model: tuple, keep: tuple[str, ...] = ("doc_id",), base: str = "base", spans: str = "spans", text: str = "text") -> DataFrame:
    """The kept columns, then base spans and all spans, as arrays of (start, end, kind, m) by start, then kind."""
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["kind"] != b["kind"], a["kind"] - b["kind"]).otherwise(a["end"] - b["end"])
    own = own_name(docs)
    value = F.coalesce(F.col(own).cast("string"), F.lit(""))
    first = docs.select(*keep, docs[text].alias(own)).withColumn(own + "base", base_spans(value))
    return first.select(*keep, F.col(own + "base").alias(base), F.array_sort(F.concat(own + "base", selected(value, F.col(own + "base"), model)), order).alias(spans))


def own_name(docs: DataFrame) -> str:
    """A beginning of column names that no column of a frame has."""
    name = "pii_"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, (*KINDS, "secret")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, the base spans' counts and digest, all spans of the listed kinds as a string, how many of them the model
    added, and the secrets that it found."""
    found = find(docs, model)
    of = lambda spans, k: F.filter(spans, lambda s: s["kind"] == k)
    listed = F.filter("spans", lambda s: s["kind"] != SECRET)
    count = lambda x: x.cast("bigint")
    return found.select(
        "doc_id",
        *(count(F.size(of("base", k))).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(listed).alias("spans"),
        count(F.size(listed) - F.size("base")).alias("n_added"),
        joined(of("spans", SECRET)).alias("secrets"),
        count(F.size(of("spans", SECRET))).alias("n_secret"),
        count(F.size("spans")).alias("n_found"),
    )


def redact(docs: DataFrame, model: tuple) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars follows the text; other columns stay."""
    own = own_name(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])
    rows = docs.withColumn(own + "base", base_spans(text))
    rows = rows.withColumn(own + "spans", F.array_sort(F.concat(own + "base", selected(text, F.col(own + "base"), model)), order))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in (*KINDS, "secret")))
    some = F.size(own + "spans") > 0
    new = replaced(text, F.col(own + "spans"), lambda s, _: F.get(names, s["kind"]))
    out = rows.withColumn("text", F.when(some, new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
