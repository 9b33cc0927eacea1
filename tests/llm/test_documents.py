"""Operators on documents against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from docassay.llm import bpe, dac, hmm, langid, mixing, pii, probminhash
from docassay.llm._common import Recent, crc_remainder, materialise, shared_dir, slices, words_of
from docassay.llm.queries import TARGETS, tokenizer_path

from .conftest import SF


def rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


# Personal data


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


TRICKY = [
    "a@b.c_x@y.z a@b..c @x.y a.b@c-d.e.f. ü.x@y.de\U0001f600m@n.op",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3 10.0.0.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 4 1",
    "+1 (555) 123-4567 +1555 +49.30.1234567.89 +1 555 123 4567 8901 234 ++12345678901",
    "mail me@x.org or +1 (212) 555-0100, host 192.168.0.1, card 5500005555555559.",
    "9" * 5000 + " " + "a" * 5000 + "@" + "b" * 50 + ".c",
    "1 2 " * 400 + "x@y.z " * 300,
    "",
]


def test_pii_base_spans_equal_the_patterns(spark, documents):
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(20_000 + k, t) for k, t in enumerate(TRICKY)], "doc_id bigint, text string"))
    texts = {(i, t) for i, t in rows(df)}
    for r in pii.digest(df, (0.0, [], {})).collect():
        want = [base_spans(t) for i, t in texts if i == r["doc_id"]][0]
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["spans"] == joined and r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in want) for j in range(4)]


def brute_added(text, model):
    """What the fitted model adds to the base spans of a text, by plain Python."""
    base = base_spans(text)
    for a, _, b in base:
        text = text[:a] + "\n" * (b - a) + text[b:]
    offset, trees, thresholds = model
    digits = lambda m: re.sub("[^0-9]", "", m)
    found = [(m.start(), m.end(), 0, m.group()) for m in regex.compile(pii.WIDE_EMAIL).finditer(text)]
    found += [(m.start(), m.end(), 1, m.group()) for m in regex.compile(pii.WIDE_IP).finditer(text)]
    for m in regex.compile(pii.WIDE_NUMBER).finditer(text):
        n = len(digits(m.group()))
        if 7 <= n <= 19 and (n < 13 or n < len(m.group())):
            found.append((m.start(), m.end(), 2 if n >= 13 and "(" not in m.group() and ")" not in m.group() else 3, m.group()))
    found += [(m.start(), m.end(), 2, m.group()) for m in regex.compile(pii.LONG_NUMBER).finditer(text)]
    found += [(m.start(), m.end(), 4, m.group()) for m in regex.compile(pii.WIDE_SECRET).finditer(text) if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())]
    side = lambda c: 0 if c == "" or c in " \t\n\v\f\r+" else 1 if regex.match(r"[\p{L}0-9]", c) else 2
    out = []
    for a, b, kind, m in found:
        d = digits(m)
        ok = [re.search(pii.PLAIN_EMAIL, re.sub(pii.DOT, ".", re.sub(pii.AT, "@", m))), re.search(pii.PLAIN_IP, re.sub(pii.DOT, ".", m)), luhn(d), 10 <= len(d) <= 15, True][kind]
        body = re.sub(r"^[0-9]{1,3}[ .-]+", "", m) if kind == 3 and len(d) >= 11 else m
        d, lead, after, number = digits(body), text[max(0, a - 24) : a], text[b : b + 1], kind in (2, 3)
        sep = next((k for k, c in ((5, "[()]"), (4, r"\."), (3, "/"), (2, "-"), (1, " ")) if re.search(c, body)), 0)
        mixed = 0 if re.search("^([0-9a-f]+|[0-9A-F]+)$", body) else 1 if re.search("^[0-9A-Za-z]+$", body) else 2 if re.search("[a-z]{8}", body) else 3
        x = (
            kind,
            0 if kind == 1 else min(len(d), 20),
            min(len(re.findall("[0-9]+", body)), 4) if number else 0,
            sep if number else 0,
            0 if kind == 4 else side(lead[-1:]),
            side(after),
            0 if kind == 4 else int(bool(re.search(pii.CUES.replace("(?i)", ""), lead, re.I))),
            0 if number or kind == 1 else min(len(body) // 8, 6),
            (0 if not d else 1 if d < "3" else 2 if d[0] == "3" else 3 if d[0] < "7" else 4) if kind == 2 else 0,
            mixed if kind == 4 else 0,
        )
        if ok and kind in thresholds and offset + sum(pii.evaluate(t, x) for t in trees) >= thresholds[kind] - 1e-9:
            out.append((a, kind, b))
    return sorted(out)


def test_pii_model_adds_what_plain_code_adds(spark, documents):
    rng = np.random.default_rng(3)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    calls, mails = ("please call", "and then", "so"), ("a{}.b@mail.example.com", "me@site.org", "jo.smith{}@host.net")
    good = [f"{calls[k % 3]} +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} or write to {mails[k % 3].format(k)}, {calls[k % 3]} 10.{k}.3.{k % 250}, token = {number(9)}ab{number(14 + k % 9)}f today" for k in range(300)]
    valid = []
    for _ in range(150):
        stem = "4" + number(14)
        valid.append(next(stem + str(x) for x in range(10) if luhn(stem + str(x))))
    bad = [f"part {k % 9}{k % 7}{1000000 + k}x order 12 345 678 {k} dated 2020-01-{k % 28 + 1:02d} 10 of 7{number(15)} and v{k}.{k}@x" for k in range(200)]
    train = spark.createDataFrame(list(enumerate([*good, *bad, *(f"{calls[k % 3]} card {c} and {c} too" for k, c in enumerate(valid))])), "doc_id bigint, text string")
    model = pii.fit(pii.cells(train))
    assert model[1] and set(model[2]) == {0, 1, 2, 3, 4}
    long = "pay " + " ".join(valid[:2]) + " " + "x" * 9000 + " ring (212) 555-1234 or 1 212 555 1234, " + "é\U0001f600" * 3000 + " me (at) site (dot) org 10[.]1[.]2[.]3 "
    texts = [*good[:5], *bad[:5], long, "+1 (826) 555-4081 190.137.223.204", "order 12 345 678 9", f"{valid[3]} 12", valid[4] + valid[5], None, "", "jane at mail dot example dot com", "x" * 19 + "1", "see 0123456789abcdef0123456789abcdef here"]
    probe = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").unionByName(documents.selectExpr("doc_id + 1000 as doc_id", "text"))
    kinds = (*pii.KINDS, "secret")
    added = 0
    want = {r["doc_id"]: (base_spans(r["text"] or ""), brute_added(r["text"] or "", model)) for r in probe.distinct().collect()}
    for r in pii.digest(probe, model).collect():
        base, more = want[r["doc_id"]]
        joined = lambda spans: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r["spans"] == joined([*base, *(x for x in more if x[1] < 4)]), r["doc_id"]
        assert r["secrets"] == joined(x for x in more if x[1] == 4)
        assert (r["n_added"], r["n_found"]) == (sum(x[1] < 4 for x in more), len(base) + len(more))
        added += r["n_added"]
    assert added >= 6
    red = {r["doc_id"]: r["text"] for r in pii.redact(probe, model).collect()}
    for i, (base, more) in want.items():
        text = next(t for k, t in [*enumerate(texts), *((j + 1000, t) for j, t in rows(documents))] if k == i) or ""
        out, at = "", 0
        for a, k, b in sorted([*base, *more], key=lambda x: (x[0], -x[2])):
            if b > at:
                out, at = out + text[at : max(a, at)] + f"[{kinds[k].upper()}]", b
        assert (red[i] or "") == out + text[at:], i


def test_pii_redaction_keeps_clashing_columns_and_long_texts(spark):
    names = ["pii_", "pii__base", "spans_", "spans_b", "base", "spans", "n_chars"]
    df = spark.createDataFrame([(1, "a.b@c.org " * 6000, *range(6), 60_000), (2, None, *range(6), None)], "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    began = time.monotonic()
    got = {r["doc_id"]: r for r in pii.redact(df, (0.0, [], {3: 0.0})).collect()}
    assert time.monotonic() - began < 60
    assert got[1]["text"] == "[EMAIL] " * 6000 and got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] is None
    assert [got[1][n] for n in names[:-1]] == [*range(6)]


def test_pii_fit_without_candidates(spark, empty):
    assert pii.fit(pii.cells(empty)) == (0.0, [], {})
    assert pii.digest(empty, (0.0, [], {})).count() == 0


# Languages


def test_language_predictions_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", crc_remainder("doc_id", 3) == 1)
    out = langid.predict(docs, langid.fit(docs.where("not held_out")), keep=("doc_id", "held_out", "lang"))
    held = [r for r in out.collect() if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_mixtures_and_defined_results(spark, documents, empty):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: r for r in langid.predict(documents, model).collect()}
    for k in (9001, 9002, 9003, 9004):
        assert (got[k]["lang_pred"], got[k]["score"], got[k]["languages"]) == ("und", 0, "")
    assert langid.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(documents, langid.fit(empty)).collect()} == {"und"}
    texts = {r["lang"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    both = (texts["fr"][:800] + " " + texts["en"][:800]).strip()
    mixed = langid.predict(spark.createDataFrame([(1, both)], "doc_id bigint, text string"), model).first()
    assert {x.split(":")[0] for x in mixed["languages"].split(",")} == {"en", "fr"}
    kept = langid.keep_identified(documents.withColumn("lang_pred", F.lit("clash")), model)
    assert kept.columns == [*documents.columns, "lang_pred"]
    assert not {9001, 9002, 9003, 9004} & {r["doc_id"] for r in kept.collect()}


# Token ids


def test_bpe_equals_the_library(library, documents):
    tok = bpe.load(tokenizer_path())
    texts = [t for _, t in rows(documents)]
    ids, at = bpe.ids_of(pa.array(texts), tok.chunk)
    decoder = bpe.Decoder(tok.pieces)
    decoded = decoder.run(ids, at).to_pylist()
    for k, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[at[k] : at[k + 1]].tolist() == want
        assert decoded[k] == library.decode(want, skip_special_tokens=False)
    assert decoder.decode(ids[: at[1]]) == decoded[0]
    # The batch machine starts anew with every text and skips ids without a piece.
    gaps = bpe.Decoder(["a", "", "b"])
    assert gaps.run(np.array([1, 0, 2, 1, 2], np.uint32), np.array([0, 3, 3, 5])).to_pylist() == ["a b", "", "b"]
    assert [gaps.decode(x) for x in ([1, 0, 2], [], [1, 2])] == ["a b", "", "b"]


def test_bpe_digests_are_those_of_the_library(spark, library, documents):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows(documents):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, bpe.digests(documents, tokenizer_path()).collect())) == sorted(want)
    with pytest.raises(ValueError):
        bpe.digests(documents.withColumn("n_tokens", F.lit(1)), tokenizer_path(), keep=("doc_id", "n_tokens"))
    assert bpe.digests(documents.limit(0), tokenizer_path()).count() == 0
    kept = bpe.tokens(documents.withColumnRenamed("text", "body").withColumn("text", F.lit("x")), tokenizer_path(), text="body", keep=("doc_id", "text"))
    assert kept.columns == ["doc_id", "text", "n_tokens", "ids", "decoded_sha256"] and kept.count() == documents.count()


def test_cache_is_bounded_in_bytes():
    cache = Recent(20_000)
    for k in range(1000):
        cache.put(f"k{k}", b"x" * 16)
        assert len(cache.new) + len(cache.old) < 80
    assert cache.get("k999") == b"x" * 16 and cache.get("k1") is None
    assert cache.put("long" * 1000, b"y") == b"y" and cache.get("long" * 1000) is None


def test_bpe_random_texts(library):
    rng = np.random.default_rng(5)
    alphabet = [*"abcdefghijklmnopqrstuvwxyz", *"ABé ñ'ßöçΣİ中文 ́  \x1c\x85.,!1²Ⅷ<|>/w", "<|endoftext|>", "'ll", "</w>", "\U0001f600", "각", "\x00"]
    tok = bpe.load(tokenizer_path())
    for _ in range(400):
        s = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert bpe.ids_of(pa.array([s]), tok.chunk)[0].tolist() == library.encode(s, add_special_tokens=False).ids, repr(s)


def test_transducer_streams_in_bounded_memory(library):
    tok = bpe.load(tokenizer_path())
    t = tok.transducer
    for unit in ("ab", "th", "inan", "zqx"):
        word = (unit * 4000)[:9000]
        emitted, seen, done = [], 0, 0

        def fed():
            nonlocal seen
            for k in range(0, len(word), 10):
                seen = min(len(word), k + 10)
                yield word[k : k + 10] + bpe.END * (seen == len(word))

        for i in t.stream(fed()):
            done += len(t.names[i].removesuffix(bpe.END))
            if seen < len(word):  # not before the lookahead has been read, and not long after it
                assert t.lookahead <= seen - done <= 3 * t.lookahead
            emitted.append(i)
        assert emitted == library.encode(word, add_special_tokens=False).ids


def small_transducers():
    rng = np.random.default_rng(11)
    for _ in range(40):  # merge lists as training makes them: of symbols that exist, in any order
        letters = [*"abc"]
        vocab, merges = list(letters), []
        for _ in range(int(rng.integers(1, 12))):
            a, b = rng.choice(vocab, 2)
            if a + b not in vocab and len(a + b) < 9:
                merges.append((a, b))
                vocab.append(a + b)
        ends = [x + bpe.END for x in letters]
        yield rng, letters, bpe.Transducer({x: k for k, x in enumerate([*vocab, *ends])}, merges, "")


def test_lookahead_suffices_and_streams_equal_plain_merging():
    for rng, letters, t in small_transducers():
        for _ in range(30):
            s = [str(x) for x in rng.choice(letters, int(rng.integers(1, 60)))]
            symbols = [*s[:-1], s[-1] + bpe.END]
            whole = t.merge_all(symbols)
            cuts = sorted({0, len(s), *rng.integers(0, len(s) + 1, 4).tolist()})
            assert [t.names[i] for i in t.stream("".join(symbols)[a : b + (b == len(s))] for a, b in itertools.pairwise(cuts))] == whole
            ends = set(np.cumsum([len(x.removesuffix(bpe.END)) for x in whole]).tolist())
            for n in range(1, len(s)):  # what a prefix says up to the lookahead, the whole says too
                part = np.cumsum([len(x) for x in t.merge_all(s[:n])])
                near = {int(x) for x in part if x <= n - t.lookahead}
                assert near == {x for x in ends if x <= n - t.lookahead}


def test_byte_decoder_waits_for_whole_characters():
    letters = bpe.byte_letters()
    pieces = [letters[b] for b in "é".encode()] + ["a</w>"]
    d = bpe.Decoder(pieces, "bytes")
    assert [d.feed(0), d.feed(1), d.feed(2), d.finish()] == ["", "é", "a ", ""]
    assert bpe.Decoder(pieces, "bytes").decode([0]) == "�"


def test_codes_are_directly_addressable():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = np.where(rng.random(n) < 0.5, rng.integers(0, 256, n), rng.integers(0, 1 << 32, n)).astype(np.uint32)
        raw = b"".join(dac.dump(np.array([7]), np.array([0]), np.array([0, n]), ids))
        codes = dac.Codes(raw)
        assert (codes.all() == ids).all()
        assert all(codes.one(i) == ids[i] for i in rng.integers(0, n, 60)) if n else True
        for a, b in np.sort(rng.integers(0, n + 1, (40, 2)), axis=1).tolist():
            assert (codes.span(a, b) == ids[a:b]).all()


def test_token_files_round_trip(spark, library, documents, empty):
    got = dac.round_trip(documents, tokenizer_path()).collect()
    want, start = [], 0
    for i, t in sorted(rows(documents)):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == sorted(want)
    assert dac.round_trip(empty, tokenizer_path()).count() == 0
    # One doc_id may hold most rows: they go to several files.
    same = spark.range(400).selectExpr("if(id < 300, null, 7L) as doc_id", "concat('text ', id % 90) as text", "id as ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = dac.write(same.repartition(4), tokenizer_path(), shared_dir(spark, "same"))
    assert manifest.where("null_first").count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    again = dac.round_trip(same, tokenizer_path()).collect()
    assert len(again) == 400 and sorted(r["start"] for r in again) == np.r_[0, np.cumsum([r["n_tokens"] for r in sorted(again, key=lambda r: r["start"])])][:-1].tolist()
    assert [r["doc_id"] for r in sorted(again, key=lambda r: r["start"])] == [None] * 300 + [7] * 100


# Near duplicates


def probability_jaccard(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x if i in y)


def brute_classes(docs):
    sets, weights = [], []
    for _, t in docs:
        w = re.split(r"[ \t\n\v\f\r]+", t.lower().strip(" \t\n\v\f\r"))
        w = [x for x in w if x]
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        sets.append({*c})
        weights.append({k: 1 + math.log2(v) for k, v in c.items()})
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            weighted = both and len(sets[a]) < 500 and max(*weights[a].values(), *weights[b].values()) > 1
            if both and (both >= 0.8 * len(sets[a] | sets[b]) - 1e-9 or (weighted and probability_jaccard(weights[a], weights[b]) >= 0.8 - 1e-9)):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least[find(k)], i)
    return {i: (least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(docs)}


def test_near_duplicate_classes_equal_brute_force(spark, documents):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(400)]
    base = list(rng.choice(words, 150))
    made = []
    for k in range(60):  # variants of one text: each is like it, few are like each other
        v = list(base)
        for p in rng.integers(0, 150, 3):
            v[p] = f"v{k}x{p}"
        made.append((30_000 + k, " ".join(v)))
    made.append((30_100, " ".join(base)))
    made += [(30_200 + k, " ".join(base[: 75 + k])) for k in range(0, 75, 5)]  # a chain of prefixes
    passage = [f"p{k}" for k in range(60)]  # alike by weight only: a passage many times, and texts of their own
    made += [(30_300 + k, " ".join(passage * 40 + [f"own{k}x{j}" for j in range(40)])) for k in range(3)]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id bigint, text string"))
    want = brute_classes(rows(df))
    got = {r["doc_id"]: r["class_id"] for r in probminhash.classes(df).collect()}
    assert got == want and got[30_301] == got[30_302] == 30_300
    kept = probminhash.deduplicate(df.withColumn("node", F.lit(1)).withColumn("near_", F.lit(2)))
    assert kept.columns == ["doc_id", "text", "node", "near_"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_probability_jaccard_equals_its_definition():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 30, rng.integers(1, 25))).astype(np.uint64) for _ in range(2))
        times = [rng.integers(1, 5, len(x)) for x in (a, b)]
        x, y = (probminhash.Weighted(s, probminhash.Weighted.repeats(t)) for s, t in zip((a, b), times, strict=True))
        plain = [dict(zip(s.tolist(), (1 + np.log2(t)).tolist(), strict=True)) for s, t in zip((a, b), times, strict=True)]
        want = probability_jaccard(*plain)
        assert math.isclose(probminhash.probability_jaccard(x, y), want, rel_tol=1e-9, abs_tol=1e-12)
        jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert probminhash.similar(x, y) == (max(want, jaccard) >= 0.8)


def test_rows_that_repeat_a_doc_id_with_another_text_stay(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    df = spark.createDataFrame([(5, a), (5, b), (5, b.upper()), (3, b), (7, c), (7, c), (8, ""), (8, None), (None, a), (None, a)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, (r["text"] or "")[:2]) for r in probminhash.deduplicate(df).collect())
    assert got == [(0, "a0"), (0, "a0"), (3, "b0"), (5, "a0"), (7, "c0"), (8, "")]


def test_near_duplicates_of_nothing(spark, empty):
    assert probminhash.classes(empty).count() == 0
    null = spark.createDataFrame([(None, "a b c d e f"), (None, None), (1, "a b c d e f")], "doc_id bigint, text string")
    assert sorted((r["class_id"] or 0) for r in probminhash.classes(null).collect())[-1] == 1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    b = np.unique(np.r_[a[:2500], rng.integers(0, 1 << 62, 400).astype(np.uint64)])
    one = lambda s: np.ones(len(s), dtype=np.int64)
    sig = probminhash.signatures([a, b, a, np.empty(0, np.uint64)], [one(a), one(b), one(a), np.empty(0, np.int64)])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.15 and (sig[0] == sig[2]).all()


# Mixing


def test_rates_match_targets(spark, documents, empty):
    labels = mixing.quality_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    out = mixing.mix(documents, labels, TARGETS).toPandas()
    assert (out.rate >= 0).all() and (out.copies >= np.floor(out.rate)).all() and (out.copies <= np.floor(out.rate) + 1).all()
    assert (out.rate[out.n_tokens == 0] == 1).all() and (out.n_tokens == 0).any()
    total = out.n_tokens.sum()
    for d, share in TARGETS.items():
        assert abs((out.rate * out.n_tokens * out[f"p_{d}"]).sum() / total - share) < 0.01
    assert mixing.mix(empty, labels, TARGETS).count() == 0
    even = mixing.mix(documents, labels.limit(0), {"a": 1, "b": 1}).toPandas()
    assert np.allclose(even.p_a, 0.5)
    again = mixing.resample(documents.withColumn("rate", F.lit(1)), labels, TARGETS)
    assert again.columns == [*documents.columns, "rate"]
    assert Counter(r["doc_id"] for r in again.collect()) == Counter({int(k): int(v) for k, v in out.groupby("doc_id").copies.sum().items() if v})


def test_rates_are_the_least_squares_ones(spark):
    rng = np.random.default_rng(9)
    p = rng.dirichlet([0.5, 0.2, 0.1], 400)
    t = rng.integers(0, 300, 400).astype(float)
    t[:3] = 0, 0, 30_000
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "n_tokens bigint, posterior array<double>")
    for targets in ([0.3, 0.3, 0.4], [0.02, 0.03, 0.95], [1.0, 0.0, 0.0]):
        moves, left = mixing.solve(df, targets, rounds=8)
        got = df.select("n_tokens", "posterior", mixing.rate_of(F.col("n_tokens"), F.col("posterior"), moves).alias("r")).toPandas()
        r, tokens, post = got.r.to_numpy(), got.n_tokens.to_numpy(), np.array(got.posterior.tolist())
        # The plain iteration on an array of rates.
        weigh = np.linalg.inv(np.einsum("i,ij,ik->jk", tokens, post, post) / tokens.sum() + 1e-9 * np.eye(3))
        own = np.ones(400)
        for _ in range(len(moves)):
            miss = np.array(targets) - (own * tokens) @ post / tokens.sum()
            own = np.maximum(0, own + mixing.STEP * (post @ weigh @ miss - mixing.SLACK * (own - 1)))
        assert np.allclose(r[tokens > 0], own[tokens > 0], rtol=1e-6, atol=1e-9) and (r[tokens == 0] == 1).all() and (r >= 0).all()
        reached = (r * tokens) @ post / tokens.sum()
        assert np.isclose(np.abs(np.array(targets) - reached).sum(), left, atol=3e-2)
        assert left < 0.6 * np.abs(np.array(targets) - tokens @ post / tokens.sum()).sum()
    assert mixing.solve(df, [0.3, 0.3, 0.4])[1] < 1e-3
    assert mixing.solve(df.limit(0), [0.5, 0.3, 0.2]) == ([], 0.0)


# Language models


def test_unigram_base_and_proper_scores(spark, documents, empty):
    df = documents.select("doc_id", "text", (crc_remainder("doc_id", 7) == 2).alias("held_out"))
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)), zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows(df)]
    counts, ends = Counter(), 0
    for _, w, held in docs:
        if not held:
            counts.update(w)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = defaultdict(list)
    for r in hmm.score(df).collect():
        got[r["doc_id"]].append(r)
    for i, w, held in docs:
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        for r in got[i]:
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w) + 1, 1 + sum(counts[x] > 0 for x in w), n, held)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert hmm.score(empty.select("doc_id", "text", F.lit(False).alias("held_out"))).count() == 0


def test_scores_equal_plain_code_under_the_trained_model(spark, documents, monkeypatch):
    trained = []
    train = hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a: trained.append(train(*a)) or trained[-1])
    monkeypatch.setattr(hmm, "OWN", 300)  # so that many words share a class
    monkeypatch.setattr(hmm, "FREQUENT", 900)  # and many are looked up by a join
    monkeypatch.setattr(hmm, "CLASSES", 300 + hmm.TAILS + 1)
    monkeypatch.setattr(hmm, "END", 300 + hmm.TAILS)
    df = documents.select("doc_id", "text", (crc_remainder("doc_id", 7) == 2).alias("held_out"))
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in hmm.score(df).collect()}
    (model,) = trained
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)), zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows(df)]
    counts = Counter(x for _, w, held in docs if not held for x in w)
    top = sorted(counts, key=lambda x: (-counts[x], int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(x)).astype(np.int64)))))[:300]
    own = {x: k for k, x in enumerate(top)}
    tail = lambda x: zlib.crc32(x[-3:].encode()) % hmm.TAILS
    n, v = Counter(), Counter()
    for x, c in counts.items():
        if x not in own:
            n[tail(x)] += c
            v[tail(x)] += 1
    for i, words, _ in docs:
        seq = [own.get(x, 300 + tail(x)) for x in words] + [hmm.END]
        within = sum(math.log10((counts[x] + 1) / (n[tail(x)] + v[tail(x)] + 1)) for x in words if x not in own)
        a, total = model.start, 0.0
        for k, c in enumerate(seq):
            a = (a if not k else a @ model.move) * model.emit[c]
            total += math.log10(a.sum())
            a = a / a.sum()
        assert math.isclose(got[i, len(seq)], total + within, rel_tol=1e-6), i


def test_baum_welch_and_forward():
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, 6, rng.integers(1, 40)) for _ in range(50)]
    model = hmm.Model.initial(np.bincount(np.concatenate(seqs), minlength=6) / sum(map(len, seqs)), 3)

    def brute(s):
        a = model.start * model.emit[s[0]]
        for x in s[1:]:
            a = (a @ model.move) * model.emit[x]
        return math.log(a.sum())

    assert np.allclose(hmm.forward(model, seqs), [brute(s) for s in seqs])
    # Counts by the sum over all paths of states.
    short = [s[:4] for s in seqs[:6]]
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for s in short:
        paths = list(itertools.product(range(3), repeat=len(s)))
        p = np.array([model.start[z[0]] * np.prod([model.emit[x, y] for x, y in zip(s, z, strict=True)]) * np.prod([model.move[a, b] for a, b in itertools.pairwise(z)]) for z in paths])
        for z, w in zip(paths, p / p.sum(), strict=True):
            starts[z[0]] += w
            for a, b in itertools.pairwise(z):
                moves[a, b] += w
            for x, y in zip(s, z, strict=True):
                emits[x, y] += w
    for window in (1, 2, 3, 100):
        got = hmm.expected(model, short, window)
        assert np.allclose(got[0], starts, atol=1e-4) and np.allclose(got[1], moves, atol=1e-4) and np.allclose(got[2], emits, atol=1e-4)
    last = -np.inf
    for _ in range(8):
        *sums, total = hmm.expected(model, seqs, window=7)
        assert np.isclose(total, hmm.forward(model, seqs).sum(), rtol=1e-5) and total > last - 0.5
        assert np.isclose(sums[2].sum(), sum(map(len, seqs))) and np.isclose(sums[1].sum(), sum(len(s) - 1 for s in seqs))
        last, model = total, hmm.maximise(*sums)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)


def test_training_runs_until_it_converges(spark):
    rng = np.random.default_rng(1)
    seqs = [np.repeat(rng.permutation(4), 3) * 3 + rng.integers(0, 3, 12) for _ in range(200)]
    shares = np.bincount(np.concatenate(seqs), minlength=12) / sum(map(len, seqs))
    for parts in (1, 3, 12):
        rows = materialise(spark.createDataFrame([(s.astype(np.uint16).tobytes(), False) for s in seqs] + [(b"", True)], "classes binary, held_out boolean").repartition(parts), "test-rows")
        model = hmm.train(rows, shares)
        *sums, total = hmm.expected(model, seqs)
        # One more round would gain next to nothing; three rounds are far from that.
        assert hmm.expected(hmm.maximise(*sums), seqs)[3] - total < 2e-3 * abs(total)
        early = hmm.Model.initial(shares)
        for _ in range(3):
            early = hmm.maximise(*hmm.expected(early, seqs)[:3])
        assert total > hmm.expected(early, seqs)[3] + 0.01 * abs(total)
    with pytest.warns(UserWarning, match="not converged"):
        hmm.train(rows, shares, most=2)
    assert np.allclose(hmm.train(materialise(rows.limit(0), "test-rows"), shares).emit, hmm.Model.initial(shares).emit)


def test_letters_of_all_planes_and_sets_of_many_languages():
    rng = np.random.default_rng(5)
    alphabets = [[chr(0x4E00 + 100 * k + j) for j in range(6)] for k in range(9)]
    word = lambda k: "".join(rng.choice(alphabets[k], 6))
    names = [f"l{k}" for k in range(9)]
    model = np.full((langid.BUCKETS, 10), -np.log(langid.BUCKETS), np.float32)
    for k in range(9):
        n = np.bincount(langid.trigrams(pa.array([" ".join(word(k) for _ in range(3000))]))[0], minlength=langid.BUCKETS)
        model[:, k] = np.log((n + 0.01) / (n.sum() + 0.01 * langid.BUCKETS))
    texts = ["\U0001f600 \U0001d7d8\U0001f4a9 12!", "\U0001f600" + word(3) + " " + word(3), " ".join(word(k) for k in range(9) for _ in range(60)), "\U00020000\U00020001"]
    pred, score, listed, noise = langid.infer(pa.array(texts), names, model)
    assert (pred[0], score[0], listed[0], noise[0]) == ("und", 0, "", 0)
    assert langid.trigrams(pa.array(texts))[3].tolist() == [0, 12, 9 * 60 * 6, 2]
    assert pred[3] != "und" and len(listed[2].split(",")) == 9
    for i in range(len(texts)):  # rows are independent of each other
        one = langid.infer(pa.array([texts[i]]), names, model)
        assert one[0][0] == pred[i] and one[2][0] == listed[i]


def test_near_copies_that_repeat_a_passage_share_bands(spark):
    docs = []
    for n in range(40):
        plain = [f"w{n}x{j}" for j in range(104)]
        docs += [(2 * n, " ".join(plain)), (2 * n + 1, " ".join(plain + plain[:24] * 1000))]
        sets, times, *_ = probminhash.shingles(pa.array([t for _, t in docs[-2:]]))
        assert probminhash.similar(*(probminhash.Weighted(s, probminhash.Weighted.repeats(t)) for s, t in zip(sets, times, strict=True)))
    rows = probminhash.sketch(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    keys = {r["doc_id"]: set(r["keys"]) for r in rows}
    assert all(keys[2 * n] & keys[2 * n + 1] for n in range(40))


# Shared


def test_slices_and_words():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c"]})
    assert [s.num_rows for s in slices(batch, chars=12)] and sum(s.num_rows for s in slices(batch, chars=12)) == 5
    codes, words, at = words_of(pa.array(["  a b\ta ", None, "b"]))
    assert [words[c].as_py() for c in codes] == ["a", "b", "a", "b"] and at.tolist() == [0, 3, 3, 4]
