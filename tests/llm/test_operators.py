"""Each operator against a plain version of its contract, on rows of every odd kind."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarrygraph.llm import decontam, langid, lines, lm, ngram_join, packing, ppm, quality, suffix_dedup, tokens

from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(r):
    return (-1 if r[0] is None else r[0], *map(str, r))


# --- 1 --------------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_quality_counts(docs, rows):
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect() if r.doc_id is not None)
    want = []
    for r in rows:
        if r[0] is not None:
            c = plain_counts(r[1])
            want.append((r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want)


def test_quality_verdict(spark):
    rng = random.Random(2)
    clean = [(i, " ".join(f"word{rng.randrange(900)}" for _ in range(80)), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(f"x{rng.randrange(900)}###" for _ in range(80)), "en", "a") for i in range(20)]
    other = [(2000 + i, " ".join("t" * rng.randrange(7, 10) + str(rng.randrange(900)) for _ in range(80)), "xx", "b") for i in range(250)]
    kept = {r.doc_id for r in quality.quality(spark.createDataFrame(clean + junk + other, "doc_id long, text string, lang string, source string")).filter("kept or base_failed").collect()}
    assert not kept & {j[0] for j in junk} and {c[0] for c in clean} <= kept and {o[0] for o in other} <= kept


def test_quality_every_rule_fires(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(f"word{rng.randrange(9000)}" for _ in range(n))
    clean = [(i, "\n".join(prose(8) for _ in range(10)), "en", "a") for i in range(300)]
    again = " ".join(f"again{k}" for k in range(8))
    planted = {
        "symbols": "\n".join(" ".join(f"word{rng.randrange(9000)}#" for _ in range(8)) for _ in range(10)),
        "word_length": "\n".join(" ".join("t" * 40 + str(rng.randrange(9000)) for _ in range(8)) for _ in range(10)),
        "dup_lines": "\n".join([x for k in range(10) for x in [f"two{k} words{k}"] * 4] + [prose(100)]),  # few words, many lines
        "repeat_words": " ".join([prose(15), again, prose(15), again, again, prose(15)]),
    }
    bad = [(1000 + k, t, "en", "a") for k, t in enumerate(planted.values())]
    rows = {r.doc_id: r for r in quality.quality(spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(rows[b[0]].base_failed for b in bad) and not any(rows[b[0]].kept for b in bad) and all(rows[c[0]].kept for c in clean)
    got = rows[1002], rows[1003]
    assert got[0].n_dup_lines == 30 and got[1].n_dup_lines == 0 and 0 < got[1].n_repeat_words < got[1].n_words / 2


def test_quality_sketch_merges(spark, docs):
    m = quality.measure(docs)
    whole = {tuple(r) for r in quality.sketches(m).groupBy("rule", "bucket").sum("n").collect()}
    halves = quality.sketches(m.filter("n_words % 2 = 0")).unionByName(quality.sketches(m.filter("n_words % 2 = 1")))
    assert whole == {tuple(r) for r in halves.groupBy("rule", "bucket").sum("n").collect()}


# --- 2 --------------------------------------------------------------------------------------


def plain_repeats(texts, size):
    count = Counter(x[i : i + size] for x in texts for i in range(len(x) - size + 1))
    out = []
    for x in texts:
        gone, end = bytearray(len(x)), 0
        for i in range(len(x) - size + 1):
            if count[x[i : i + size]] > 1:
                for j in range(max(i, end), i + size):
                    gone[j] = 1
                end = i + size
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(docs, rows, hot):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, hot=hot).collect()), key=key)
    want = plain_repeats([(r[1] or "").encode() for r in rows], suffix_dedup.SIZE)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)
    assert any(w[1] for w in want) and any(0 < w[1] < w[0] for w in want)


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(1500):
        s = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(40))]
        assert suffix_dedup.suffix_array(np.array(s, np.int64)) == sorted(range(len(s)), key=lambda i: s[i:])


# --- 3 --------------------------------------------------------------------------------------


def distance(a, b):
    """Least edits of a against any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz    "
    say = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(k, say(rng.randrange(60, 200))) for k in range(12)] + [(50, None), (51, ""), (52, "tiny")]
    docs, truth = [], set()
    for k in range(40):
        text = say(rng.randrange(50, 400))
        if k % 2:
            item, body = items[k % 12]
            body = list(body.upper() if k % 3 else body)
            for _ in range(int(len(body) * (k % 8) / 40)):
                at = rng.randrange(len(body))
                body[at : at + 1] = rng.choice([[], ["q"], ["z", "z"]])
            at = rng.randrange(len(text))
            text = text[:at] + "".join(body) + text[at:]
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1])]
    block = decontam.Block([i for i, _ in items], [t for _, t in items], decontam.RATE)
    low = lambda t: decontam._NORMAL[np.frombuffer(t.encode(), np.uint8)].tobytes()
    for d, t in docs:
        for i, e, x in zip(block.ids, block.edits, block.items):
            if t and distance(x.tobytes(), low(t)) <= e:
                truth.add((d, int(i)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == truth and len(truth) > 8
    for r in found:
        assert distance(block.items[list(block.ids).index(r.item_id)].tobytes(), low(dict(docs)[r.doc_id])[r.start : r.end]) <= r.edits
    kept = {r.doc_id for r in decontam.clean(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in truth}


def test_decontamination_repetitive_texts():
    """Runs and periods in texts and items, against every alignment; a megabyte of one byte takes seconds."""
    rng = random.Random(3)
    odd = ["a" * 90, "-" * 40 + "=" * 40, "ab" * 45, " " * 60 + "tail of words", "word " + "x" * 70, "a" * 30 + "b" * 8 + "a" * 30]
    items = [*odd, "".join(rng.choice("ab") for _ in range(80))]
    block = decontam.Block(list(range(len(items))), items, decontam.RATE)
    texts = ["a" * 300, "b" + "a" * 89 + "b", "-" * 60 + "=" * 60, "ba" * 60, "x" * 66, " " * 200 + "tail of words", "a" * 29 + "b" * 8 + "a" * 31, "a" * 80 + "b" * 10, "", "ab" * 20]
    texts += ["".join(rng.choice(["a" * 9, "b", "-" * 12, "ab", "=" * 20]) for _ in range(20)) for _ in range(30)]
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    off = np.cumsum([0, *map(len, data)])
    got = {(row, i) for row, i, *_ in block.matches(np.concatenate(data), off)}
    low = lambda t: decontam._NORMAL[np.frombuffer(t.encode(), np.uint8)].tobytes()
    assert got == {(r, i) for r, t in enumerate(texts) for i, x in enumerate(items) if t and distance(low(x), low(t)) <= block.edits[i]}
    began = time.time()
    long = np.frombuffer(b"a" * 500_000 + b" " * 500_000, np.uint8)
    assert {i for _, i, *_ in block.matches(long, np.array([0, len(long)]))} >= {0}
    assert time.time() - began < 60


def test_decontamination_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(k, f"passage number {k} of many words that no text has {k * 7}") for k in range(9)], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 120)
    assert decontam.contamination(docs, bench).count() == 0 and decontam.clean(docs, bench).count() == docs.count()


# --- 4 and 7 --------------------------------------------------------------------------------

ODD = ["a  b c", "a \nb c's", "a<|endoftext|> b <|endoftext|>c", "x  y z", "'s 'll don't 12 34a  !!", "\n\na b\n", "  lead x", "I'M a1b22c x<|startoftext|>y", "ΣΑΣ é é Å İx ŒU", "½ ² ³ª", "foo...bar!!! 100,000.50", "ﬁ ＡＢＣ a_b __"]


def test_token_counts(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    count = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, path).collect()), key=key)
    assert got == sorted(((r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 1024) for r in rows), key=key)
    lengths = tokens.Lengths(path)
    assert lengths(ODD) == [count(x) for x in ODD]
    text = " ".join(ODD * 50)
    assert lengths.whole(text, 100) == count(text)


def check_packing(pieces, documents, size=2048):
    """Every id in one piece, gapless sequences; gives the share of padding."""
    inside, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        inside[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for doc, ids in documents.items():
        end = 0
        for p in sorted(inside.pop(doc), key=lambda p: p.start):
            assert p.start == end and p.doc_tokens == len(ids)
            end += p.length
            assert zlib.crc32(np.array(ids[p.start : end], "<u4").tobytes()) == p.ids_crc32
        assert end == len(ids)
    used = 0
    for s in sequences.values():
        end = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert 0 < end <= size
        used += end
    return 1 - used / (size * len(sequences))


def test_packing(spark, docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    mine = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows if r[0] is not None}
    assert check_packing(packing.pack(mine, path).collect(), want) < 0.03
    assert packing.pack(docs, path).agg({"length": "sum"}).first()[0] == sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert packing.pack(empty, path).count() == 0
    encode = packing.WordIds(path, 1)
    for x in ODD:
        raw = np.frombuffer(x.encode(), np.uint8)
        assert encode(raw, np.array([0, len(raw)]))[0].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1]


def test_packing_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [(k, "some words " * (k * 7 % 90)) for k in range(120)]
    pieces = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), path).collect()
    check_packing(pieces, {k: t.encode(x, add_special_tokens=False).ids + [1] for k, x in texts})


# --- 5 and 9 --------------------------------------------------------------------------------


def grams_of(texts, order):
    trie = {}
    for x in texts:
        past = b"\n" * order
        for s in x:
            for k in range(order + 1):
                c = trie.setdefault(past[len(past) - k :], {})
                c[s] = c.get(s, 0) + 1
            past = (past + bytes([s]))[-order:] if order else b""
    return trie


def coded(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return "".join(w + " " for w in WORD.findall(low)).encode() + b"\n"


@pytest.mark.parametrize("parts, order", [(False, 2), (True, 2), (False, lm.ORDER)])
def test_lm(docs, rows, parts, order):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    got = lm.lm_score(docs, order=order, model_bytes=20_000 if parts else lm.MODEL_BYTES).collect()
    words = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    count = Counter(w for r in rows if not held(r[0]) for w in words(r[1]))
    n, v = sum(count.values()), len(count)
    trie = grams_of([coded(r[1]) for r in rows if not held(r[0])], order)
    want = []
    for r in rows:
        w = words(r[1])
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        score = -ppm.adaptive_bits(coded(r[1]), order, trie) * math.log10(2)
        want.append((r[0], held(r[0]), len(w), sum(count[x] > 0 for x in w), n, round(base, 3), round(score, 2)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3), round(r.score, 2)) for r in got), key=key)[:5] == sorted(want, key=key)[:5]
    for a, b in zip(sorted(got, key=lambda r: (r.n_tokens, r.base_score, str(r.doc_id))), sorted(want, key=lambda r: (r[2], r[5], str(r[0])))):
        assert a.n_tokens == b[2] and a.n_known == b[3] and abs(a.score - b[6]) < 1e-4 * abs(b[6]) + 0.02


def test_adaptive_learns():
    assert ppm.adaptive_bits(b"abcabcabcabcabcabcabcabc", 3) < 0.6 * ppm.adaptive_bits(bytes(range(97, 121)), 3)


def test_language_id(spark, docs, empty):
    rng = random.Random(4)
    say = {"aa": "the of and thing with er ing", "bb": "le des ré eau que tion", "cc": "der und ung chen ß ö"}
    made = [(k, " ".join(rng.choice(say[lang].split()) for _ in range(rng.randrange(6, 50))), lang) for k, lang in enumerate(list(say) * 60)]
    out = langid.language_id(spark.createDataFrame(made + [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None)], "doc_id long, text string, lang string")).collect()
    truth = {k: lang for k, _, lang in made}
    assert all(r.lang_pred == truth[r.doc_id] for r in out if r.doc_id < 900) and sum(r.held_out for r in out) > 10
    assert {(r.lang_pred, r.score) for r in out if r.doc_id >= 900} == {("und", 0.0)} and all(0 <= r.score <= 1 for r in out)
    odd = langid.language_id(docs).collect()
    assert len(odd) == docs.count() and {r.lang_pred for r in odd} <= {"en", "fr", "de", "und"}
    assert langid.language_id(empty).count() == 0
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.language_id(unlabelled).collect()} == {"und"}
    kept = langid.in_known_language(docs)
    assert kept.columns == docs.columns and kept.filter("text is null").count() == 0


def plain_bits(text, trie, order):
    """Code length by escapes of method C, without exclusion."""
    total, past = 0.0, b"\n" * order
    for s in text:
        for k in range(order, -1, -1):
            c = trie.get(past[len(past) - k :])
            if c:
                n, d = sum(c.values()), len(c)
                if s in c:
                    total -= math.log2(c[s] / (n + d))
                    break
                total -= math.log2(d / (n + d))
        else:
            total += 8
        past = (past + bytes([s]))[-order:]
    return total


def test_language_id_memory(docs, monkeypatch):
    """Both functions of the workers take a few MB, however much text a batch has."""
    run, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *schema: run.append(f) or plain(self, f, *schema))
    langid.language_id(docs)
    rng = random.Random(4)
    text = [" ".join(words(rng, 1000)) for _ in range(600)]
    batch = pa.table({"doc_id": range(600), "text": text, "lang": ["en", "fr"] * 300}).combine_chunks().to_batches()[0]
    for f, columns in zip(run, (["doc_id", "text", "lang"], ["doc_id", "text"]), strict=True):
        tracemalloc.start()
        assert sum(b.num_rows for b in f(iter([batch.select(columns)])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 25e6, (f.__name__, most)


def test_language_id_code_lengths(docs, rows):
    crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5
    names = sorted({r[2] for r in rows if r[2] and r[1] and crc(r[0])})
    tries = [grams_of([r[1].encode() for r in rows if r[2] == x and r[1] and crc(r[0])], langid.ORDER) for x in names]
    want = []
    for r in rows:
        t = (r[1] or "").encode()
        if not any(map(str.isalpha, r[1] or "")):
            want.append((r[0], crc(r[0]) == 0, "und", 0.0))
            continue
        cost = [plain_bits(t, x, langid.ORDER) for x in tries]
        score = 1 / sum(2 ** (-(c - min(cost)) / math.sqrt(len(t))) for c in cost)
        want.append((r[0], crc(r[0]) == 0, names[cost.index(min(cost))], score))
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in langid.language_id(docs).collect()), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6, (a, b)
    assert len({w[2] for w in want}) > 2


def test_clashing_columns(spark, rows):
    """Columns of any names come through the stages that return the columns of documents."""
    odd = ["doc_id", "text", "lang", "source", "score", "lang_pred", "bits_per_byte", "n_lines", "n_removed", "a.b", "c`d", "_text", "_page", "_0", "_gone", "_row", "th"]
    mine = [(*r[:4], *range(len(odd) - 4)) for r in rows]
    schema = ", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in zip(odd, ["long", "string", "string", "string"] + ["int"] * 20))
    frame = spark.createDataFrame(mine, schema)
    bench = spark.createDataFrame([(1, rows[2][1][:200])], "item_id long, text string")
    whole = {r[:1] + r[2:] for r in mine}
    for out in (langid.in_known_language(frame), lines.without_boilerplate(frame), ngram_join.one_of_each(frame), decontam.clean(frame, bench)):
        got = [tuple(r) for r in out.collect()]
        assert out.columns == odd and got and {r[:1] + r[2:] for r in got} <= whole
    for out in (quality.quality(frame), suffix_dedup.remove_repeats(frame), decontam.contamination(frame, bench), tokens.token_counts(frame, public_tokenizers.path("byte_bpe_50k.json")), lm.lm_score(frame), packing.pack(frame, public_tokenizers.path("word_bpe_49k.json")), langid.language_id(frame), ngram_join.similar(frame), lines.dedup_lines(frame)):
        assert out.count() >= len(rows) or "item_id" in out.columns


# --- 8 --------------------------------------------------------------------------------------


def test_line_dedup(docs, rows):
    pages, on = Counter(r[3] for r in rows), Counter()
    for r in rows:
        for x in set((r[1] or "").split("\n")) if r[1] is not None else ():
            on[(r[3], x)] += bool(WORD.search(x))
    gone = {k for k, n in on.items() if n >= lines.LEAST_PAGES and n > lines.RATIO * pages[k[0]]}
    want = []
    for r in rows:
        if r[1] is None:
            want.append((r[0], r[3], 0, 0, None))
            continue
        all_, kept = r[1].split("\n"), [x for x in r[1].split("\n") if (r[3], x) not in gone]
        want.append((r[0], r[3], len(all_), len(all_) - len(kept), "\n".join(kept)))
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.source, r.n_lines, r.n_removed, r.text) for r in out.collect()), key=key) == sorted(want, key=key)
    assert gone


# --- 10 -------------------------------------------------------------------------------------


def plain_similar(rows):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset())
    near = [[j for j in range(len(rows)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((r[0], len(sets[i]), len(near[i]), min(ids) if ids else None))
    return out


#: Many groups, parts of fragments, blocks and bins.
DIVIDED = [ngram_join.Sizes(), ngram_join.Sizes(400, 16, 50, 3, 200, 3, 7, 2, 300), ngram_join.Sizes(300, 64, 7, 2, 90, 2, 5, 4, 100)]


@pytest.mark.parametrize("sizes", DIVIDED)
def test_ngram_jaccard(docs, rows, sizes):
    got = sorted(((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in ngram_join.similar(docs, sizes).collect()), key=key)
    want = sorted(plain_similar(rows), key=key)
    assert got == want and sum(w[2] for w in want) > 40


@pytest.mark.parametrize("sizes", DIVIDED)
def test_ngram_jaccard_chains(spark, sizes):
    """Near copies of near copies, and sets of every size up to 300 at the edges of the bands."""
    rng = random.Random(6)
    rows, w = [], words(rng, 70)
    for k in range(60):
        rows.append((len(rows), " ".join(w)))
        w = [x if rng.random() < 0.9 else f"n{rng.randrange(10**6)}" for x in w] + words(rng, rng.randrange(9))
    for n in (1, 2, 3, 5, 38, 39, 40, 63, 64, 65, 66, 153, 154, 255, 256, 257, 258, 300):
        w = words(rng, n, 10**6)
        rows += [(len(rows) + k, " ".join(w[: max(1, int(n * s))] + words(rng, e, 10**6))) for k, (s, e) in enumerate([(1, 0), (0.6, 0), (0.61, 0), (1, n // 2), (0.8, n // 9)])]
    got = sorted(((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), sizes).collect()), key=key)
    assert got == sorted(plain_similar(rows), key=key)


def test_ngram_jaccard_moves_sets_once(spark):
    """However many n-grams a band has, a set goes to its own band and the next one, once each."""
    rng = random.Random(9)
    table = pa.table({"text": [" ".join(words(rng, rng.randrange(70, 250), 10**6)) for _ in range(60)]})
    cls, n = ngram_join._classes(*ngram_join.shingles(*ngram_join.text_bytes(table["text"])), 60)
    plan = ngram_join._plan(spark.createDataFrame([(int(c), int(k)) for c, k in zip(cls, n)], "cls long, n long"), ngram_join.Sizes(group_ngrams=200))
    moved = sum(len(g) for b in ngram_join._segments(plan)(iter(table.to_batches())) for g in b.column("grams").to_pylist())
    guests = n[(n < 256) & (100 * n >= 60 * 256)].sum()
    assert 0 < moved <= 8 * (n.sum() + guests)


def test_ngram_jaccard_small_leads(docs, rows):
    """Prefixes in so many parts that they take several rounds of files."""
    got = sorted(((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in ngram_join.similar(docs, ngram_join.Sizes(400, 16, 50, 3, 200, 3, 7, 2, 300, 20)).collect()), key=key)
    assert got == sorted(plain_similar(rows), key=key)


def test_one_of_each(docs, rows):
    kept = ngram_join.one_of_each(docs)
    roots = {r[3] for r in plain_similar(rows) if r[0] is not None}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == roots


# --- empty tables ---------------------------------------------------------------------------


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.fixture
def near_copies(spark):
    """150 texts with a near copy each and 150 without, and how many words they have; none is small enough to be broadcast."""
    rng = random.Random(31)
    texts = [[f"{rng.getrandbits(20):x}" for _ in range(2000)] for _ in range(300)]
    texts += [["edited", *w[1:]] for w in texts[:150]]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(4, "doc_id").localCheckpoint(), 2000 * len(texts)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ngram_jaccard_moves_texts_of_small_clusters(spark, near_copies):
    docs, n = near_copies
    before = shuffled(spark)
    assert Counter(r.n_similar for r in ngram_join.similar(docs).collect()) == {0: 150, 1: 300}
    assert shuffled(spark) - before < 12 * n


def test_one_of_each_moves_no_text_that_stays(spark, near_copies):
    docs, n = near_copies
    kept = ngram_join.one_of_each(docs)
    before = shuffled(spark)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(300))
    assert shuffled(spark) - before < 3 * n


def test_empty(empty, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for out in (quality.quality(empty), suffix_dedup.remove_repeats(empty), decontam.contamination(empty, bench), tokens.token_counts(empty, path), lm.lm_score(empty), lines.dedup_lines(empty), ngram_join.similar(empty)):
        assert out.count() == 0
