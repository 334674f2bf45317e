"""The pipeline against a plain version of its stages, one after the other."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quarrygraph.llm import decontam, langid, lines

from tests.llm.test_operators import WORD, check_packing, distance, grams_of, plain_bits, plain_similar


def test_run(spark, tmp_path):
    rng = random.Random(8)
    say = {"aa": "the of and thing with er ing was to in", "bb": "le des ré eau que tion dans pour un la"}
    prose = lambda lang, n: " ".join(rng.choice(say[lang].split()) + str(rng.randrange(60)) for _ in range(n))
    items = [(k, prose("aa", 20)) for k in range(4)]
    rows = []
    for k in range(60):
        lang = "aa" if k % 3 else "bb"
        text = prose(lang, rng.randrange(40, 90)) + "\n" + prose(lang, 20)
        if k % 4 == 0:
            text += "\nShared boilerplate of the site."
        if k % 9 == 0:
            text += "\n" + items[k % 4][1] + " and more"
        rows.append((k, text, lang, f"s{k % 2}"))
    for k in range(10):
        w = rows[k + 10][1].split(" ")
        w[rng.randrange(len(w))] = "edit"
        rows.append((100 + k, " ".join(w), rows[k + 10][2], "s0"))
    rows += [(200, None, "aa", "s0"), (201, "", None, None), (202, "12 34 ...", "bb", "s1"), (203, rows[5][1], None, "s1")]
    rows = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    order = langid.ORDER
    tries = [grams_of([r[1].encode() for r in rows if r[2] == lang and r[1]], order) for lang in ("aa", "bb")]

    def known(text):
        if not text or not any(map(str.isalpha, text)):
            return False
        cost = [plain_bits(text.encode(), t, order) for t in tries]
        return 1 / sum(2 ** (-(c - min(cost)) / math.sqrt(len(text.encode()))) for c in cost) >= 0.5

    docs = [r for r in rows if known(r[1])]
    pages, on = Counter(r[3] for r in docs), Counter()
    for r in docs:
        for x in set(r[1].split("\n")):
            on[(r[3], x)] += bool(WORD.search(x))
    gone = {k for k, n in on.items() if n >= lines.LEAST_PAGES and n > lines.RATIO * pages[k[0]]}
    docs = [(r[0], "\n".join(x for x in r[1].split("\n") if (r[3], x) not in gone)) for r in docs]
    docs = [r for r, s in zip(docs, plain_similar(docs)) if s[0] == s[3]]
    low = lambda t: decontam._NORMAL[np.frombuffer(t.encode(), np.uint8)].tobytes()
    leak = lambda t: any(distance(low(i), low(t)) <= min(int(decontam.RATE * len(i.encode())), len(i.encode()) // 8 - 1) for _, i in items)
    docs = [r for r in docs if not leak(r[1])]
    assert gone and 0 < len(docs) < 60
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check_packing(pieces, {d: t.encode(x, add_special_tokens=False).ids + [1] for d, x in docs})
    assert {p.doc_id for p in pieces} == {d for d, _ in docs}


def test_stages():
    assert [re.sub("_.*", "", n) for n, _ in corpus_pipeline.STAGES] == ["language", "line", "ngram", "decontamination", "packing"]
