"""The clause grammar against a plain reading, what labels teach, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import toxicity as tx
from lexforge.llm.tokens import ALNUM, Tokens

PLAIN = tx.Lexicon({"idiot": 2.0, "scum": 3.0}, {"vequ": 4.0, "vequab": 5.0})


def read(text):
    """(word, marks) of the matches, one word at a time."""
    words, clause = [], 0
    word = ""
    for ch in text.lower() + ".":
        if tx._WORD.fullmatch(ch):
            word += ch
            continue
        if word:
            words.append((word, clause))
            word = ""
        clause += ch in '.,;:!?\n\r\x0b\x0c|"()'
    out, negated, said, seen, last, before = [], 0, False, False, None, None
    for i, (w, c) in enumerate(words):
        if c != before:
            negated, said, seen, last, before = 0, False, False, None, c
        insult = w in ("idiot", "scum") or (w.startswith("vequ") and len(w) > 4)
        if insult or w in tx.THREATS:
            out.append([i, insult, bool(negated) and insult, said and insult, seen])
            last = out[-1] if not seen else None
        negated = 3 if w in tx.NEGATIONS else max(negated - 1, 0)
        if w in tx.REPORTS:
            said = True
        if w in tx.TARGETS:
            if last:
                last[4] = True
            last, seen = None, True
    return [(i, n, s, li) for i, insult, n, s, li in out if insult or li]


def test_grammar_equals_a_plain_reading():
    rng = random.Random(0)
    pool = ["idiot", "Scum", "vequab", "vequx", "vequ", "kill", "you", "not", "said", "x", "y", "z", "été", "."]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 9, 40]))) for _ in range(400)]
    texts += ["kill x x x x x x you", "not x x x idiot", "not a b idiot", "he said you idiot. scum", "idiot|you", "a" * 5000,
              "x " * 5000 + "idiot " + "x " * 5000 + "you"]
    t = Tokens([s.encode() for s in texts], ALNUM, True)
    at, kind, weight, marks = tx.matches(t, PLAIN)
    got = [[] for _ in texts]
    for a, d, m in zip(at, t.doc[at], marks):
        got[d].append((a - t.first[d], bool(m & tx.NEGATED), bool(m & tx.REPORTED), bool(m & tx.LINKED)))
    assert got == [read(s) for s in texts]
    by_word = {t.words(a, a + 1)[0]: w for a, w in zip(at, weight)}
    assert by_word[b"vequab"] == 4.0 and by_word[b"scum"] == 3.0 and b"vequ" not in by_word


def test_longer_stems_win():
    t = Tokens([b"vequabx vequx vequab"], ALNUM, True)
    assert tx.matches(t, PLAIN)[2].tolist() == [5.0, 4.0, 4.0]
    assert Tokens([b"ab abc x"], ALNUM, True).heads(2).tolist()[:2] == [tx.text_hash(b"ab")] * 2


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    vocab = [a + b for a in "kmnprst" for b in ("ola", "ine", "uv", "érre")]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([5, 40, 200]))]
        toxic = i % 9 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zork" + rng.choice(vocab), "idiot", "Blarg"]))
        rows.append((i, " ".join(words), "x", 1.0, "y"))
        if i % 2:
            labels.append((i, int(toxic)))
    return rows, labels


SCHEMA = "doc_id long, text string, clauses string, Toxicity double, id string"


def scored(spark, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return tx.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_labels_teach_words_and_stems(spark):
    rows, labels = corpus()
    out = scored(spark, rows, labels)
    assert out.columns == ["doc_id", "text", "id", "toxicity", "clauses"]
    got = {r.doc_id: r.toxicity for r in out.collect()}
    assert all((got[i] >= 0.3) == (i % 9 == 0) for i in range(600))
    assert {r.doc_id: r.toxicity for r in scored(spark, rows, labels).collect()} == got


def test_odd_rows(spark):
    rows, labels = corpus(300)
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, "ola " * 200_000), (1004, "idiot. " * 5), (1004, "idiot. " * 5),
           (None, "idiot scum"), (1005, "\x00é日本")]
    rows = rows + [(i, t, "x", 1.0, "y") for i, t in odd] + rows[:9]
    labels = labels + labels[:5] + [(1, 1), (None, 1), (2, None)] + [(1004, 1)]
    got = scored(spark, rows, labels).select("doc_id", "toxicity", F.size("clauses").alias("n")).collect()
    assert len(got) == len(rows)
    one = {r.doc_id: r for r in got}
    assert one[1000].toxicity == one[1001].toxicity == one[1002].toxicity and one[1000].n == 0
    assert one[1004].n == 5 and one[1004].toxicity > 0.3 and one[None].n == 2
    assert 0 <= one[1003].toxicity < 0.3


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(0, 1)]])
def test_without_labels_fixed_words_hold(spark, labels):
    rows, _ = corpus(30)
    got = {r.doc_id: r.toxicity for r in scored(spark, [*rows, (77, "you idiot scum", "x", 1.0, "y")], labels).collect()}
    assert got[77] > 0.5 and np.mean([got[i] < 0.3 for i in range(1, 9)]) == 1
    assert scored(spark, [], labels).count() == 0
