"""Token counts against a plain Viterbi over each pre-token."""

import random

from tallyrack.llm.common import tokenizer_path
from tallyrack.llm.tokencount import MARK, TrieCounter, corpus_tokens, token_counts, unigram


def viterbi(vocabulary, word):
    text, byte = MARK + word.decode("utf-8", "replace"), min(vocabulary.values()) - 10
    best = [(0.0, 0)]
    for d in range(1, len(text) + 1):
        width = len(text[d - 1].encode())
        ways = [(best[d - 1][0] + width * byte, -best[d - 1][1] - width)]
        ways += [(best[a][0] + vocabulary[text[a:d]], -best[a][1] - 1) for a in range(d) if text[a:d] in vocabulary]
        s, c = max(ways)
        best.append((s, -c))
    return best[-1][1]


def test_counts_are_viterbis():
    r = random.Random(1)
    vocabulary = {c: -5.0 - i for i, c in enumerate("abc" + MARK)} | {"".join(r.choices("abc" + MARK, k=r.randint(2, 5))): -float(r.randint(4, 12)) for _ in range(60)}
    words = [bytes("".join(r.choices("abcdé", weights=[5, 5, 5, 1, 1], k=r.randint(1, 12))), "utf-8") for _ in range(500)]
    words += [b"a" * 700, b"ab" * 1500, "é".encode() * 600, b"\0", b"\xff"]
    counter = TrieCounter(vocabulary)
    assert [counter.total([w]) for w in words] == [viterbi(vocabulary, w) for w in words]
    assert counter.total(words[:400]) == sum(viterbi(vocabulary, w) for w in words[:400])


def test_documents(spark):
    vocabulary = unigram(tokenizer_path("piece_bpe_32k.model"))
    texts = ["", None, " \n\t", "The quick brown fox", "naïve Straße 東京", "x" * 5000, "tie", "tie"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")]
    counts = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"))
    want = {(i, len((t or "").encode()), len((t or "").encode().split()), sum(viterbi(vocabulary, w) for w in (t or "").encode().split())) for i, t, _ in rows if t != "x" * 5000}
    got = {tuple(g) for g in counts.collect()}
    assert want <= got and len(got) == len(rows)
    assert corpus_tokens(counts).first().docs == len(rows)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
