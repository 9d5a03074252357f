"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, reported speech, clause
border, other), and three small transducers read them:

* negation: an insult up to three words behind a negation is marked negated;
* reported speech: an insult behind a verb of saying, up to the clause border,
  is marked reported;
* target: a target before or after an insult or threat in its clause links them.

Their composition is one table; a clause's matches are summed by mark, and a
document is scored from these sums and their density by a logistic
function.  A threat counts only when linked, so isolated words of that kind
are no match.  Only clauses that hold an insult or a threat are read by the table.

Insults are the fixed words below and what labels teach: words, and stems of
``STEMS`` letters, that stand in toxic rows far more often than in clean ones.
They are taken one at a time by their likelihood ratio on rows not yet covered
``COVER`` times, so words that merely accompany a chosen one add nothing.
Weights are log odds; the coefficients of the logistic function start from
fixed ones and are fitted with a ridge around them.  The fit uses at most
``per_class`` label rows of each class, drawn by a seeded hash (its documented
bound); scoring reads all documents and whole texts.

Defined results: a null or empty text has no matches and gets the score of
such; documents that repeat an id or a text are scored alike; an id with
several labels counts as toxic if one says so; without labels the fixed words
and coefficients hold; an empty table gives an empty result; input columns that
clash with an output column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import free_name, seeded_hash, without, written
from lexforge.llm.tokens import ALNUM, Tokens, chunks, text_hash

# fixed values: word lists of the grammar
INSULTS = ["clown", "coward", "disgusting", "dumb", "fool", "idiot", "loser", "moron", "pathetic", "scum", "stupid",
           "trash", "vermin", "worthless"]
THREATS = ["attack", "beat", "burn", "destroy", "hurt", "kill", "murder", "punish", "shoot", "stab"]
TARGETS = ["du", "dich", "euch", "er", "he", "her", "him", "ihr", "she", "sie", "tes", "their", "them", "they", "toi",
           "tu", "usted", "vous", "you", "your"]
NEGATIONS = ["aucun", "jamais", "kein", "keine", "never", "nicht", "nie", "no", "not", "nunca", "pas", "without"]
REPORTS = ["called", "claimed", "dijo", "dit", "quoted", "reported", "sagte", "said", "says", "told", "wrote"]

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BORDER = range(7)
SYMBOLS = 7
NEGATED, REPORTED, LINKED = 1, 2, 4            # marks that transitions put out
STEMS = range(3, 8)
COVER = 3
FEATURES = ("plain", "negated", "reported", "threat", "links", "density")
#: bias, then one coefficient a feature, before anything is fitted
START = np.array([-3.0, 1.5, 0.6, 0.6, 1.5, 0.5, 0.8])
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in '.,;:!?\n\r\x0b\x0c|"()']] = True


class Transducer:
    """next[state, symbol] and marks[state, symbol]; state 0 starts."""

    def __init__(self, states: int):
        self.next = np.repeat(np.arange(states)[:, None], SYMBOLS, axis=1)
        self.marks = np.zeros((states, SYMBOLS), dtype=np.int64)
        self.next[:, BORDER] = 0

    def compose(self, other: Transducer) -> Transducer:
        """Both read each symbol; the marks of both are put out."""
        n, m = len(self.next), len(other.next)
        out = Transducer(n * m)
        out.next = (self.next[:, None, :] * m + other.next[None, :, :]).reshape(n * m, SYMBOLS)
        out.marks = (self.marks[:, None, :] | other.marks[None, :, :]).reshape(n * m, SYMBOLS)
        return out


def negation(scope: int = 3) -> Transducer:
    t = Transducer(scope + 1)                   # the state is the number of words still negated
    for s in range(scope + 1):
        t.next[s, :BORDER] = max(s - 1, 0)
        t.next[s, NEGATION] = scope
        t.marks[s, INSULT] = NEGATED if s else 0
    return t


def reported_speech() -> Transducer:
    t = Transducer(2)
    t.next[:, REPORT] = 1
    t.marks[1, INSULT] = REPORTED
    return t


def target() -> Transducer:
    t = Transducer(3)                           # nothing yet, a target, an insult or threat without one
    t.next[0, TARGET] = 1
    t.next[0, [INSULT, THREAT]] = 2
    t.marks[1, [INSULT, THREAT]] = LINKED
    t.next[2, TARGET] = 1
    t.marks[2, TARGET] = LINKED
    return t


GRAMMAR = negation().compose(reported_speech()).compose(target())


class Lexicon:
    """Symbols and weights of words, by exact hash or by the hash of a stem."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        exact = {w: (THREAT, 1.0) for w in THREATS}
        exact |= {w: (s, 0.0) for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        exact |= {w: (INSULT, x) for w, x in words.items()}
        self.exact = self._table(exact)
        by_size: dict[int, dict] = {}
        for s, x in stems.items():
            by_size.setdefault(len(s.encode()), {})[s] = (INSULT, x)
        self.stems = {n: self._table(t) for n, t in sorted(by_size.items())}

    @staticmethod
    def _table(entries: dict[str, tuple[int, float]]):
        h = np.array([text_hash(w.encode()) for w in entries], dtype=np.uint64)
        by = np.argsort(h)
        symbol = np.array([e[0] for e in entries.values()], dtype=np.int64)
        return h[by], symbol[by], np.array([e[1] for e in entries.values()])[by]

    def symbols(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of every word; longer stems win over shorter ones, whole words over stems."""
        symbol = np.zeros(len(t.start), dtype=np.int64)
        weight = np.zeros(len(t.start))
        for n, table in [*self.stems.items(), (None, self.exact)]:
            h, s, w = table
            if not len(h):
                continue
            own = t.hash if n is None else t.heads(n)
            at = np.minimum(np.searchsorted(h, own), len(h) - 1)
            hit = h[at] == own
            if n is not None:
                hit &= t.end - t.start > n
            symbol[hit], weight[hit] = s[at[hit]], w[at[hit]]
        return symbol, weight


def _clauses(t: Tokens) -> np.ndarray:
    """Number of the clause of each word."""
    ends = np.concatenate(([0], np.cumsum(_ENDS[t.buf])))
    new = np.ones(len(t.start), dtype=bool)
    new[1:] = (ends[t.start[1:]] > ends[t.end[:-1]]) | (t.doc[1:] != t.doc[:-1])
    return np.cumsum(new) - 1


def matches(t: Tokens, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, symbol, weight, marks) of all insults and linked threats, in word order."""
    symbol, weight = lexicon.symbols(t)
    clause = _clauses(t)
    some = np.zeros(int(clause[-1]) + 1 if len(clause) else 0, dtype=bool)
    some[clause[(symbol == INSULT) | (symbol == THREAT)]] = True
    at = np.flatnonzero(some[clause]) if len(clause) else np.empty(0, dtype=np.int64)
    # words behind three others of no kind in the clause change no state
    plain = (symbol == OTHER)
    idle = np.zeros(len(symbol), dtype=bool)
    if len(symbol) > 3:
        idle[3:] = (plain[3:] & plain[2:-1] & plain[1:-2] & plain[:-3] & (clause[3:] == clause[:-3]))
    at = at[~idle[at]]
    if not len(at):
        return at, at, weight[at], at
    first = np.concatenate(([True], clause[at][1:] != clause[at][:-1]))
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(at)))
    by = np.argsort(-size, kind="stable")
    start, size = start[by], size[by]
    state = np.zeros(len(start), dtype=np.int64)
    marks = np.zeros(len(at), dtype=np.int64)
    for step in range(int(size[0])):              # all clauses that have a word here, at once
        n = int(np.searchsorted(-size, -step, "left"))
        k = start[:n] + step
        s = symbol[at[k]]
        marks[k] = GRAMMAR.marks[state[:n], s]
        state[:n] = GRAMMAR.next[state[:n], s]
    kind = symbol[at]
    keep = (kind == INSULT) | (kind == THREAT) | ((marks & LINKED > 0) & (kind == TARGET))
    at, kind, marks = at[keep], kind[keep], marks[keep]
    late = np.flatnonzero(kind == TARGET)         # links the insult or threat before it
    marks[late - 1] |= LINKED
    keep = (kind == INSULT) | ((kind == THREAT) & (marks & LINKED > 0))
    return at[keep], kind[keep], weight[at[keep]], marks[keep]


def features(t: Tokens, lexicon: Lexicon) -> tuple[np.ndarray, tuple]:
    """texts x FEATURES, and the matches."""
    at, kind, weight, marks = found = matches(t, lexicon)
    doc, n = t.doc[at], t.n_texts
    insult, linked = kind == INSULT, (marks & LINKED) > 0
    groups = (insult & (marks & (NEGATED | REPORTED) == 0), insult & (marks & NEGATED > 0),
              insult & (marks & NEGATED == 0) & (marks & REPORTED > 0), kind == THREAT)
    sums = [np.bincount(doc[g], weights=weight[g], minlength=n) for g in groups]
    links = np.bincount(doc[linked], minlength=n)
    words = np.maximum(np.diff(t.first), 1)
    return np.log1p(np.stack([*sums, links, 100 * sum(sums) / words], axis=1)), found


def _log_odds(pos, neg, n_pos, n_neg):
    return np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))


def _evidence(pos, neg, n_pos, n_neg):
    """Likelihood ratio statistic of a share of toxic rows above that of clean rows, else 0."""
    def part(k, n):
        k, n = np.asarray(k, dtype=float), float(max(n, 1))
        p, all_p = k / n, (pos + neg) / max(n_pos + n_neg, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(k * np.log(p / all_p)) + np.nan_to_num((n - k) * np.log((1 - p) / (1 - all_p)))
    g = 2 * (part(pos, n_pos) + part(neg, n_neg))
    return np.where(pos / max(n_pos, 1) > neg / max(n_neg, 1), g, 0.0)


def _terms(text: str) -> set[str]:
    """Whole words (``=word``) and proper stems (``^stem``) of a text."""
    words = set(_WORD.findall(text))
    return {"=" + w for w in words} | {"^" + w[:k] for k in STEMS for w in words if len(w) > k}


def _candidates(sample: DataFrame, n_pos: int, n_neg: int, most: int) -> list[str]:
    """The terms of most evidence in the sample."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                (pos if toxic else neg).update(_terms(text))
        terms = list(pos | neg)
        for lo in range(0, len(terms), 50_000):
            some = terms[lo:lo + 50_000]
            yield pa.RecordBatch.from_pydict({"term": some, "pos": [pos[t] for t in some], "neg": [neg[t] for t in some]})

    rows = (sample.mapInArrow(count, "term string, pos long, neg long").groupBy("term")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 3"))
    lift = F.col("pos") * F.lit(n_neg) / ((F.col("neg") + 0.5) * F.lit(max(n_pos, 1)))
    rows = rows.where(lift > 3).orderBy(F.desc(F.col("pos") * F.log(lift)), F.desc(F.length("term")), "term").limit(most)
    return [r["term"] for r in rows.collect()]


def _chosen(terms: list[str], has: np.ndarray, toxic: np.ndarray, enough: float = 14.0, most: int = 300) -> list[int]:
    """Terms by evidence on toxic rows not covered COVER times; none inside another."""
    n_pos, n_neg = int(toxic.sum()), int((~toxic).sum())
    neg = has[~toxic].sum(axis=0)
    rows, covered = has[toxic], np.zeros(n_pos, dtype=np.int64)
    size = np.array([len(t) for t in terms])
    open_terms = np.ones(len(terms), dtype=bool)
    out: list[int] = []
    while len(out) < most and open_terms.any():
        left = covered < COVER
        pos = rows[left].sum(axis=0)
        g = np.where(open_terms, _evidence(pos, neg, max(int(left.sum()), 1), n_neg), 0)
        best = int(np.lexsort((-size, -np.round(g, 6)))[0])
        if g[best] < enough or pos[best] < 3:
            break
        out.append(best)
        covered += rows[:, best]
        t = terms[best]
        for i in np.flatnonzero(open_terms):
            u = terms[i]
            if u[1:].startswith(t[1:]) and t[0] == "^" or t[1:].startswith(u[1:]) and u[0] == "^" or u == t:
                open_terms[i] = False
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients by Newton steps, with a ridge around START; features never count against toxicity."""
    x = np.hstack((np.ones((len(x), 1)), x))
    b = START.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * (b - START)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b = b - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        b[1:] = np.maximum(b[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _lexicon(sample: DataFrame, n_pos: int, n_neg: int, most: int) -> Lexicon:
    words, stems = dict.fromkeys(INSULTS, 3.0), {}
    if not n_pos or not n_neg:
        return Lexicon(words, stems)
    number = {t: i for i, t in enumerate(dict.fromkeys([*_candidates(sample, n_pos, n_neg, most),
                                                        *("=" + w for w in INSULTS)]))}

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "has": [
                sorted(number[t] for t in _terms(text) if t in number) for text in batch["text"]]})
    rows = sample.mapInPandas(present, "toxic boolean, has array<int>").collect()     # per_class bounds it
    toxic = np.array([r["toxic"] for r in rows], dtype=bool)
    has = np.zeros((len(rows), len(number)), dtype=bool)
    for i, r in enumerate(rows):
        has[i, r["has"]] = True
    pos, neg = has[toxic].sum(axis=0), has[~toxic].sum(axis=0)
    odds = np.clip(_log_odds(pos, neg, n_pos, n_neg), 0.5, 6)
    for w in INSULTS:                             # a fixed word keeps its weight until labels speak
        i = number["=" + w]
        seen = pos[i] + neg[i]
        words[w] = float((3.0 * 5 + odds[i] * seen) / (5 + seen))
    names = list(number)
    for i in _chosen(names, has, toxic):
        (words if names[i][0] == "=" else stems)[names[i][1:]] = float(odds[i])
    return Lexicon(words, stems)


def fit(sample: DataFrame, size: dict[bool, int], terms: int) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and coefficients from bounded (text, toxic) rows; ``size``: label rows of each class in all."""
    drawn = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = drawn.get(True, 0), drawn.get(False, 0)
    lexicon = _lexicon(sample, n_pos, n_neg, terms)
    if not n_pos or not n_neg:
        return lexicon, START

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [features(t, lexicon)[0] for _, _, t in chunks([b.encode() for b in batch["text"]], ALNUM, True)]
            yield pd.DataFrame({"toxic": batch["toxic"], "x": list(np.concatenate(x)) if x else []})
    rows = sample.mapInPandas(measured, "toxic boolean, x array<double>").collect()
    rows.sort(key=lambda r: (r["toxic"], r["x"]))             # sums do not depend on where rows were read
    y = np.array([r["toxic"] for r in rows], dtype=float)
    weight = np.where(y > 0, size[True] / n_pos, size[False] / n_neg)
    return lexicon, _logistic(np.array([r["x"] for r in rows]), y, weight * len(y) / weight.sum())


def _drawn(docs: DataFrame, labels: DataFrame, per_class: int, seed: int) -> tuple[DataFrame, dict]:
    """At most ``per_class`` (text, toxic) rows of each class, and how many labels each class has."""
    size = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = Window.partitionBy("toxic").orderBy(seeded_hash(seed, F.col("id")), "id")
    some = labels.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= per_class).drop("place")
    # 2 * per_class rows: that bounds the broadcast, and the texts are read without a shuffle
    rows = docs.join(F.broadcast(some), "id").select("text", "toxic", seeded_hash(seed, F.col("id"), F.col("text")).alias("at"))
    again = Window.partitionBy("toxic").orderBy("at", "text")      # an id may have many rows
    rows = rows.withColumn("place", F.row_number().over(again)).where(F.col("place") <= per_class)
    return written(rows.select("text", "toxic")), size


def score_toxicity(docs: DataFrame, labels: DataFrame, train_where: Column | None = None, text_col: str = "text",
                   id_col: str = "doc_id", label_col: str = "toxic", per_class: int = 2500, terms: int = 3000,
                   seed: int = 3) -> DataFrame:
    """``docs`` with toxicity (0 to 1) and clauses, the matched words with first_word,
    weight, negated, reported and linked.

    ``labels`` holds ``id_col`` and ``label_col`` (0 or 1); ``train_where``, on its
    columns, says which of its rows may teach.
    """
    spark = docs.sparkSession
    taught = (labels.where(F.col(label_col).isNotNull() & (F.lit(True) if train_where is None else train_where))
              .groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("toxic")))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    sample, size = _drawn(texts, taught, per_class, seed)
    lexicon, coef = fit(sample, size, terms)
    model = spark.sparkContext.broadcast((lexicon, coef))

    @F.pandas_udf("toxicity double, clauses array<struct<first_word:long, weight:double, negated:boolean, "
                  "reported:boolean, linked:boolean>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexicon, coef = model.value
        for text in batches:
            scores, clauses = [], []
            for lo, hi, t in chunks(text.tolist(), ALNUM, True):
                x, (at, _, weight, marks) = features(t, lexicon)
                scores.append(1 / (1 + np.exp(-np.clip(coef[0] + x @ coef[1:], -30, 30))))
                rows = [{"first_word": a - t.first[d], "weight": w, "negated": bool(m & NEGATED),
                         "reported": bool(m & REPORTED), "linked": bool(m & LINKED)}
                        for a, d, w, m in zip(at.tolist(), t.doc[at].tolist(), weight.tolist(), marks.tolist())]
                cut = np.searchsorted(t.doc[at], np.arange(hi - lo + 1)).tolist()
                clauses += [rows[i:j] for i, j in zip(cut, cut[1:])]
            yield pd.DataFrame({"toxicity": np.concatenate(scores) if scores else [], "clauses": clauses})

    out = without(docs, [c for c in ("toxicity", "clauses") if c not in {text_col, id_col}])
    got = free_name(out, "_got")
    out = out.withColumn(got, score(F.lower(text_col).cast("binary")))
    return out.withColumns({"toxicity": F.col(f"{got}.toxicity"), "clauses": F.col(f"{got}.clauses")}).drop(got)
