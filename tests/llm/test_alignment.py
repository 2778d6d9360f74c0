"""The alignment against brute force over byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from featureops.llm import alignment
from featureops.llm.common import table

NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain_tokens():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in letters} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in letters)}

    def of(text):
        ea = a.encode(" " + text, add_special_tokens=False)
        tokens_a = [(i, bytes(table[c] for c in t)) for i, t in zip(ea.ids, ea.tokens)]
        tokens_b = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            tokens_b.append((i, bytes.fromhex(p[3:5]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (tokens_a, tokens_b) if text and all(b"".join(x for _, x in t) == whole for t in (tokens_a, tokens_b)) else ([], [])

    return of


def ranges(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at := at + len(raw)))
    return out


def brute(rows):
    of = plain_tokens()
    docs, held = [], Counter()
    for doc_id, text in rows:
        a, b = map(ranges, of(text or ""))
        links, j = [], 0
        for i, lo, hi in a:
            while j < len(b) and b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        line = []
        for lo, hi in zip([0, *ends], ends):
            line.append("|".join(",".join(str(i) for i, s, _ in side if lo <= s < hi) for side in (a, b))) if len(text) < 20_000 else None
        docs.append((doc_id, len(a), len(b), len(ends), links, hashlib.sha256(";".join(line).encode()).hexdigest() if a else ""))
        held.update(set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return sorted(((d, na, nb, g, len(ls), sum(held[x] == best[x[0]] for x in ls), sum(held[x] for x in ls), sha) for d, na, nb, g, ls, sha in docs), key=str)


def got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


ROWS = [
    (1, "plain words, twice: plain words"), (1, "plain words, twice: plain words"), (2, None), (3, ""), (None, "no id"), (4, "   "), (5, " a  b\t\n c "),
    (6, "ünï çödé 😀 　 ﬁ ́e"), (7, "▁ is a space there"), (8, "<|endoftext|><s></s><unk><0x41>"), (9, "a" * 3_000), (10, "字" * 999 + "\x00\r"),
    (11, "internationalization unbelievable 12345678901234567890"),
]


@pytest.mark.parametrize("batch,chunk", [(1 << 20, 8 << 20), (1, 1), (200, 900)])
def test_equals_brute_force(spark, batch, chunk):
    g = random.Random(3)
    words = ["the", "token", "ization", "über", "naïve", "x1y2", "日本語", "😀", "don't", "  ", "\n", "é"]
    rows = ROWS + [(100 + i, " ".join(g.choice(words) for _ in range(g.randrange(60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for c in ("chunk", "place", "pairs", "held", "docs", "count", "best", "told"):
        df = df.withColumn(c, F.lit("x"))
    assert got(alignment.alignment(df, alignment.public_vocabularies(), batch, chunk)) == brute(rows)
    assert alignment.alignment(df.limit(0), alignment.public_vocabularies()).count() == 0


def test_very_long_texts(spark):
    rows = [(1, "word " * 300_000), (2, "x" * 200_000), (3, "word")]
    by = {r.doc_id: r for r in alignment.alignment(spark.createDataFrame(rows, "doc_id long, text string"), alignment.public_vocabularies()).collect()}
    want = {r[0]: r for r in brute(rows)}
    for i in (1, 2, 3):
        assert tuple(by[i][n] for n in NAMES[:-1]) == want[i][:-1]
    assert by[3].groups_sha256 == want[3][-1]


def test_rank_table_gives_the_ids_of_the_file(spark):
    """The faster encoder against the library, over all texts of the small table and odd ones; and the other way of
    encoding, for files whose ids don't follow their merges."""
    import json

    from tokenizers import Tokenizer

    source = open(alignment.public_vocabularies()[0], encoding="utf-8").read()
    encode, _ = alignment.byte_level_encoder(source)
    library = Tokenizer.from_str(source)
    library.encode_special_tokens = True
    texts = [t or "" for _, t in ROWS] + [r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    assert all(encode(t) == library.encode(t, add_special_tokens=False).ids for t in texts)
    spec = json.loads(source)
    spec["model"]["merges"] = spec["model"]["merges"][:2][::-1] + spec["model"]["merges"][2:]
    other, _ = alignment.byte_level_encoder(json.dumps(spec))
    assert all(other(t) == Tokenizer.from_str(json.dumps(spec)).encode(t, add_special_tokens=False).ids for t in texts[:5])


def test_planes():
    for n in (0, 1, 5):
        x = np.array([random.randrange(1 << 32) for _ in range(n)], np.int64)
        assert alignment.from_planes(alignment.planes(x)).tolist() == x.tolist()


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    want = brute(rows)
    have = got(alignment.op12_asof_alignment(spark, "/root/testdata/sf0.001"))
    long = {i for i, t in rows if len(t or "") >= 20_000}
    assert [r[:-1] for r in have] == [r[:-1] for r in want]
    assert [r for r in have if r[0] not in long] == [r for r in want if r[0] not in long]
