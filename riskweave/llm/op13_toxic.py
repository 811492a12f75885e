"""Toxicity by Levenshtein automata over a lexicon trie (operator 13).

1. Lexicon: words that toxic training documents use far oftener than the others, counted by distinct
   contexts (word before, word after), so that copies count once. Learned on at most about ``train_rows``
   labelled documents a class; the lexicon has at most ``max_terms`` words.
2. The trie of the lexicon meets each token's Levenshtein automaton (letters missing, added, replaced or
   swapped; 0, 1 or 2 edits by the term's length). Sets of (trie node, edits) are numbered as they turn up, so a
   batch of tokens steps through a transition table together and drops out as soon as no term is in reach.
3. A window of ``WINDOW`` tokens around each match, and its line, tell its use: quoted, mentioned ("the word"),
   addressed to someone, or plain. Training documents correct the weights of the uses.
4. A form's evidence is the log odds of toxic against other training documents that hold it, both kinds
   weighted alike, leaning on its term's other misspelt forms, and those on a fixed prior by edits: common
   words that merely look like a term lose their weight. A training document's own label is left out of its evidence.
5. A document's evidence is the sum over its forms, each by its strongest use; a monotone table over
   the evidence, from all training documents, gives the score.

Only labels whose crc32(doc_id) mod 5 is not 0 are read; label, lang, source and doc_id are no input of
a score. Counts of forms and the score table cover all training documents.

Defined results: null text is empty; texts without a match take the score of no evidence (the share of toxic
training documents without a match, 0 for all texts without training documents); unless training rows of both kinds exist the
lexicon is ``extra_terms`` alone (empty by default); a null doc_id is held out; an id labelled both ways counts as toxic, a null label as none; rows that share an id each
give a row; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import prepared, written

TRAIN_ROWS = 4000  # labelled documents a class that the lexicon is learned on, about
MAX_TERMS = 2000
WINDOW = 8
LEAST_CONTEXTS = 5
HELD_STATES = 100_000  # automaton states that a worker remembers

USES = ("quoted", "mentioned", "addressed", "plain")
USE_WEIGHTS = (0.1, 0.4, 1.0, 0.9)  # before training documents correct them
EDIT_PRIORS = (1.0, 0.9, 0.75)  # how far a form with 0, 1 or 2 edits is believed before training documents say more
USE_FAITH, FORM_FAITH, SCORE_FAITH = 20.0, 4.0, 2.0  # pseudo-counts of the weights, of forms, of the score table
SUREST = 6.0  # most log odds of one form
LOW, STEP = -5.0, 0.2  # evidence of the first of the score table's 101 places, and from place to place

# Words that mention a term instead of using it, and words that address someone.
MENTIONS = """word words term terms quote quoted quotes quoting cited said says called meaning definition defined phrase
wort wörter begriff zitat zitiert sagte bedeutung mot mots terme citation cité signifie définition palabra palabras
término cita citado significa definición""".split()
ADDRESSES = "you your yours youre u ur du dich dir dein deine ihr euch tu toi ton vous votre tú te usted ustedes tus".split()
SYMBOLS = "0123456789@$*!"  # parts of a token between letters, one or two at a time
QUOTES = "\"“”„«»‟"


def budget(length: int) -> int:
    """Edits that a term of this length allows."""
    return 0 if length < 4 else 1 if length < 8 else 2


class Automaton:
    """All strings within the edits of some term, as a table that grows with the states that turn up.
    State 0 is out of reach of every term, state 1 is the start."""

    def __init__(self, terms: list[str], allowed: list[int]):
        letters = sorted({c for t in terms for c in t})
        self.letter = {c: k + 1 for k, c in enumerate(letters)}
        self.classes = np.zeros(0x110000, dtype=np.int16)
        for c, k in self.letter.items():
            self.classes[ord(c)] = k
        self.children: list[dict[int, int]] = [{}]
        self.reach = [-1]  # most edits of the terms below a node
        self.ends: list[list[tuple[int, int]]] = [[]]  # (edits allowed, term) at a node
        for i, (term, most) in enumerate(zip(terms, allowed)):
            node = 0
            self.reach[0] = max(self.reach[0], most)
            for c in term:
                nxt = self.children[node].get(self.letter[c])
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][self.letter[c]] = nxt
                    self.children.append({})
                    self.reach.append(-1)
                    self.ends.append([])
                node = nxt
                self.reach[node] = max(self.reach[node], most)
            self.ends[node].append((most, i))
        self.forget()

    def forget(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[dict] = []
        self.table = np.full((1024, len(self.letter) + 1), -1, dtype=np.int32)
        self.term = np.full(1024, -1, dtype=np.int32)
        self.edits = np.zeros(1024, dtype=np.int8)
        self.add({})
        start: dict = {}
        self.put(start, 0, 0, 0)
        self.add(start)

    def put(self, states: dict, node: int, waits: int, edits: int) -> None:
        """(node, letter that must still come to complete a swap or 0) reached with ``edits``; letters may be missing."""
        if edits <= self.reach[node] and edits < states.get((node, waits), 99):
            states[node, waits] = edits
            if not waits:
                for child in self.children[node].values():
                    self.put(states, child, 0, edits + 1)

    def add(self, states: dict) -> int:
        key = frozenset(states.items())
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.sets)
            self.sets.append(states)
            if at >= len(self.term):
                grow = len(self.term)
                self.table = np.concatenate([self.table, np.full((grow, self.table.shape[1]), -1, dtype=np.int32)])
                self.term = np.concatenate([self.term, np.full(grow, -1, dtype=np.int32)])
                self.edits = np.concatenate([self.edits, np.zeros(grow, dtype=np.int8)])
            found = min(((e, i) for (node, waits), e in states.items() if not waits for most, i in self.ends[node] if e <= most), default=None)
            if found:
                self.edits[at], self.term[at] = found
        return at

    def after(self, state: int, letter: int) -> int:
        out: dict = {}
        for (node, waits), e in self.sets[state].items():
            if waits:
                if letter == waits:
                    self.put(out, node, 0, e)
                continue
            self.put(out, node, 0, e + 1)  # added
            for other, child in self.children[node].items():
                if other == letter:
                    self.put(out, child, 0, e)
                    continue
                self.put(out, child, 0, e + 1)  # replaced
                swapped = self.children[child].get(letter)
                if swapped is not None:
                    self.put(out, swapped, other, e + 1)
        return self.add(out)

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        out = self.table[states, letters]
        if (out < 0).any():
            new = np.nonzero(out < 0)[0]
            for pair in np.unique(states[new].astype(np.int64) << 16 | letters[new]).tolist():
                to = self.after(pair >> 16, pair & 0xFFFF)
                self.table[pair >> 16, pair & 0xFFFF] = to
            out = self.table[states, letters]
        return out

    def run(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Final states of the tokens."""
        if len(self.sets) > HELD_STATES:
            self.forget()
        final = np.zeros(len(starts), dtype=np.int32)
        alive, states, depth = np.arange(len(starts)), np.ones(len(starts), dtype=np.int32), 0
        while len(alive):
            states = self.step(states, self.classes[cps[starts[alive] + depth]])
            depth += 1
            over = starts[alive] + depth == ends[alive]
            final[alive[over]] = states[over]
            stay = ~over & (states != 0)
            alive, states = alive[stay], states[stay]
        return final


class Tokens:
    """Lower-cased texts as code points with the bounds of their tokens: runs of letters, with one or two symbols inside."""

    kind = np.full(0x110000, -1, dtype=np.int8)  # 0 other, 1 letter, 2 symbol

    def __init__(self, texts: list[str]):
        coded = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
        sizes = np.array([len(c) // 4 for c in coded], dtype=np.int64)
        self.cps = cps = np.frombuffer(b"\n\0\0\0".join([*coded, b"\n\0\0\0\n\0\0\0"]), dtype="<u4")
        self.bounds = np.concatenate([[0], np.cumsum(sizes + 1)])  # a line break parts the texts
        kinds = self.kind[cps]
        if (kinds < 0).any():
            for c in np.unique(cps[kinds < 0]).tolist():
                self.kind[c] = 1 if chr(c).isalpha() else 2 if chr(c) in SYMBOLS else 0
            kinds = self.kind[cps]
        letter, symbol = kinds == 1, kinds == 2
        at = lambda m, k: np.concatenate([np.zeros(k, bool), m[:-k]]) if k > 0 else np.concatenate([m[-k:], np.zeros(-k, bool)])
        if symbol.any():
            before, after = at(letter, 1), at(letter, -1)
            letter = letter | symbol & (before & after | before & at(symbol, -1) & at(letter, -2) | at(letter, 2) & at(symbol, 1) & after)
        edge = np.diff(np.concatenate([[0], letter.astype(np.int8), [0]]))
        self.starts, self.ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        self.doc = np.searchsorted(self.bounds, self.starts, side="right") - 1
        self.first = np.searchsorted(self.starts, self.bounds[:-1])
        self.last = np.searchsorted(self.starts, self.bounds[1:])

    def text(self, k: int) -> str:
        return self.cps[self.starts[k]:self.ends[k]].tobytes().decode("utf-32-le", "surrogatepass")


def within(cumulated: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return cumulated[hi] - cumulated[lo]


class Finder:
    """Matches of the lexicon in texts, with their uses."""

    def __init__(self, terms: list[str], window: int = WINDOW):
        self.terms, self.window = terms, window
        known = set(terms)
        cues = [(w, k) for k, words in ((1, MENTIONS), (2, ADDRESSES)) for w in words if w not in known]
        self.cue = np.array([0] * len(terms) + [k for _, k in cues], dtype=np.int8)
        self.automaton = Automaton([*terms, *(w for w, _ in cues)], [*(budget(len(t)) for t in terms), *(0 for _ in cues)])

    def __call__(self, texts: list[str]) -> list[tuple[int, str, int, int, int]]:
        """(text, form, term, edits, use) of every match."""
        t = Tokens(texts)
        if not len(t.starts) or not self.terms:
            return []
        final = self.automaton.run(t.cps, t.starts, t.ends)
        term = self.automaton.term[final]
        cue = np.where(term >= 0, self.cue[term], -1)
        hits = np.nonzero(cue == 0)[0]
        if not len(hits):
            return []
        lo = np.maximum(hits - self.window, t.first[t.doc[hits]])
        hi = np.minimum(hits + self.window + 1, t.last[t.doc[hits]])
        mentioned, addressed = (within(np.concatenate([[0], np.cumsum(cue == k)]), lo, hi) > 0 for k in (1, 2))
        quotes, lines = np.nonzero(np.isin(t.cps, [ord(c) for c in QUOTES]))[0], np.nonzero((t.cps == 10) | (t.cps == 13))[0]
        line = np.searchsorted(lines, t.starts[hits])
        begin, end = np.where(line > 0, lines[line - 1] + 1, 0), lines[line]
        count = lambda a, b: np.searchsorted(quotes, b) - np.searchsorted(quotes, a)
        quoted = (count(begin, t.starts[hits]) % 2 == 1) & (count(t.ends[hits], end) > 0) | (t.cps[begin] == ord(">"))
        use = np.select([quoted, mentioned, addressed], [0, 1, 2], 3)
        edits = self.automaton.edits[final[hits]]
        return [(d, t.text(h), k, e, u) for d, h, k, e, u in
                zip(t.doc[hits].tolist(), hits.tolist(), term[hits].tolist(), edits.tolist(), use.tolist())]


def parts(batch, at: int):
    """Slices of a batch whose texts (column ``at``) have at most about a million characters together."""
    lo, size = 0, 0
    for hi, n in enumerate(batch.column(at).to_pylist()):
        size += len(n)
        if size > 1 << 20:
            yield batch.slice(lo, hi + 1 - lo)
            lo, size = hi + 1, 0
    if lo < batch.num_rows:
        yield batch.slice(lo)


def trained_on(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, y) of the labels that may be learned from."""
    taught = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) != 0
    return labels.where(taught & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max((F.col(label_col) == 1).cast("int")).alias("y"))


def lexicon(docs: DataFrame, taught: DataFrame, id_col: str, text_col: str, train_rows: int, max_terms: int) -> list[tuple[str, float]]:
    """(term, share of its contexts that are toxic, both kinds of documents weighted alike), the surest first."""
    per = {r["y"]: r["n"] for r in taught.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(per) < 2:
        return []
    share = {y: min(1.0, train_rows / n) for y, n in per.items()}
    chosen = taught.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0]) * (1 << 30))
    # about 2 x train_rows rows are broadcast, whatever the size of the tables
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id").select("y", "text")

    def run(batches):
        import pyarrow as pa
        import xxhash
        for batch in batches:
            for part in parts(batch, 1):
                y, t = part.column(0).to_pylist(), Tokens(part.column(1).to_pylist())
                words = [t.text(k) for k in range(len(t.starts))]
                out = {(words[k], xxhash.xxh3_64_intdigest(f"{words[k - 1] if k > lo else ''} {words[k + 1] if k + 1 < hi else ''}") >> 1, y[d])
                       for d, (lo, hi) in enumerate(zip(t.first.tolist(), t.last.tolist())) for k in range(lo, hi) if 2 <= len(words[k]) <= 40}
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int32()))],
                                                     names=["word", "context", "y"])

    counts = written(texts.mapInArrow(run, "word string, context long, y int").distinct().groupBy("word").agg(
        F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")), "toxic-words")
    total = counts.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count_if(F.col("n1") + F.col("n0") >= LEAST_CONTEXTS).alias("words")).first()
    if not total["n1"] or not total["n0"]:
        return []
    n, q = F.col("n1") + F.col("n0"), total["n1"] / (total["n1"] + total["n0"])
    side = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / n / p)).otherwise(0.0)
    sure = side("n1", q) + side("n0", 1 - q)  # of the chance that a word without leaning has such counts, its logarithm, at least
    toxic = (F.col("n1") + 0.5) / total["n1"]
    p = toxic / (toxic + (F.col("n0") + 0.5) / total["n0"])
    rows = counts.where((n >= LEAST_CONTEXTS) & (sure > math.log(max(1, total["words"])) + 3) & (p > 0.9)).select(
        "word", F.round(p, 6).alias("p"), F.round(sure, 6).alias("sure")).orderBy(F.desc("sure"), "word").limit(max_terms).collect()
    return [(r["word"], r["p"]) for r in rows]


FOUND = "row long, doc_id long, form string, term int, edits int, " + ", ".join(f"n{k} int" for k in range(len(USES)))


def matches(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per (document, form): its term and edits, and the matches by use;
    a document without a match has one row with null form."""
    prepared(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("form", pa.string()), ("term", pa.int32()), ("edits", pa.int32()),
                            *((f"n{k}", pa.int32()) for k in range(len(USES)))])
        find, row = Finder(terms, window), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in parts(batch, 1):
                ids, seen = part.column(0).to_pylist(), [{} for _ in range(part.num_rows)]
                for d, form, term, edits, use in find(part.column(1).to_pylist()):
                    seen[d].setdefault((form, term, edits), [0] * len(USES))[use] += 1
                rows = []
                for doc_id, forms in zip(ids, seen):
                    row += 1
                    rows += [(row, doc_id, *key, *uses) for key, uses in forms.items()] or [(row, doc_id, *[None] * (len(schema) - 2))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, FOUND)


def evidence(seen: DataFrame, terms: list[tuple[str, float]], scale: float) -> DataFrame:
    """``seen`` (matches with the training label ``y`` of their document, or null) with ``odds``: the log odds of their forms."""
    faith = FORM_FAITH * (1 + scale) / 2
    own = F.element_at(F.array(*[F.lit(p) for _, p in terms]), F.col("term") + 1)
    first = own * F.element_at(F.array(*[F.lit(p) for p in EDIT_PRIORS]), F.col("edits") + 1)
    share = lambda prior, n1, n0: (faith * prior + scale * n1) / (faith + scale * n1 + n0)
    # a frequent form is one row a task before the shuffle; its rows on the way back are split by AQE
    forms = seen.where("y is not null").groupBy(F.col("form").alias("_form"), "term", "edits").agg(F.sum("y").alias("_n1"), F.sum(1 - F.col("y")).alias("_n0"))
    kin = forms.where("edits > 0").groupBy(F.col("term").alias("_term"), F.col("edits").alias("_edits")).agg(
        F.sum(share(first, F.col("_n1"), F.col("_n0"))).alias("_shares"), F.count(F.lit(1)).alias("_forms"))
    rows = seen.join(forms.select("_form", "_n1", "_n0"), F.col("form") == F.col("_form"), "left").join(
        kin, (F.col("term") == F.col("_term")) & (F.col("edits") == F.col("_edits")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    prior = (FORM_FAITH * first + zero(F.col("_shares"))) / (FORM_FAITH + zero(F.col("_forms")))
    p = share(prior, zero(F.col("_n1")) - zero((F.col("y") == 1).cast("int")), zero(F.col("_n0")) - zero((F.col("y") == 0).cast("int")))
    odds = F.greatest(F.least(F.log(p / (1 - p)), F.lit(SUREST)), F.lit(-SUREST))
    return rows.withColumn("odds", F.when(p >= 1, F.lit(SUREST)).otherwise(odds)).drop("_form", "_n1", "_n0", "_term", "_edits", "_shares", "_forms")


def use_weights(seen: DataFrame, scale: float) -> list[float]:
    """The weights of the uses, corrected by the training documents that hold an exact term in each."""
    ns = [f"n{k}" for k in range(len(USES))]
    per = seen.where("edits = 0 and y is not null").groupBy("row", "y").agg(*[F.max(F.col(n) > 0).alias(n) for n in ns])
    r = per.agg(*[F.count_if(F.col(n) & (F.col("y") == y)).alias(f"{n}{y}") for n in ns for y in (0, 1)]).first()
    return [(USE_FAITH * w + scale * r[f"{n}1"]) / (USE_FAITH + scale * r[f"{n}1"] + r[f"{n}0"]) for n, w in zip(ns, USE_WEIGHTS)]


def score_table(counts: dict[int, tuple[int, int]]) -> list[float]:
    """Non-decreasing scores of the 101 places of evidence from {place: (documents, toxic ones)}: shares
    leaning on what the evidence says by itself, neighbours that fall are pooled."""
    n1, n = sum(y for _, y in counts.values()), sum(n for n, _ in counts.values())
    base = math.log((n1 + 0.5) / (n - n1 + 0.5))
    blocks: list[list[float]] = []  # weight, weighted score, length
    for k in range(101):
        here, toxic = counts.get(k, (0, 0))
        said = 1 / (1 + math.exp(-(base + LOW + k * STEP)))
        weight, value = here + 1.0, (toxic + SCORE_FAITH * said) / (here + SCORE_FAITH)
        blocks.append([weight, weight * value, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] > blocks[-1][1] / blocks[-1][0]:
            w, v, m = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + v, blocks[-1][2] + m]
    return [round(min(1.0, v / w), 6) for w, v, m in blocks for _ in range(m)]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
          label_col: str = "toxic", train_rows: int = TRAIN_ROWS, max_terms: int = MAX_TERMS,
          extra_terms: tuple[str, ...] = (), window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    prepared(docs.sparkSession)
    taught = written(trained_on(labels, label_id_col, label_col), "toxic-labels")
    terms = lexicon(docs, taught, id_col, text_col, train_rows, max_terms)
    terms += [(w.lower(), 1.0) for w in extra_terms if w.lower() not in {t for t, _ in terms}]
    found = written(matches(docs, [t for t, _ in terms], id_col, text_col, window), "toxic-found")
    known = taught.select(F.col("doc_id").alias("_id"), "y")
    rows = found.select("row", "doc_id").distinct().join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    per = {r["y"]: r["n"] for r in rows.where("y is not null").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sums = F.lit(0.0)
    if terms:
        scale = per.get(0, 1) / per.get(1, 1)
        seen = found.where("form is not null").join(known, F.col("doc_id") == F.col("_id"), "left")
        use = F.greatest(*[F.when(F.col(f"n{k}") > 0, w).otherwise(0.0) for k, w in enumerate(use_weights(seen, scale))])
        held = evidence(seen, terms, scale).groupBy(F.col("row").alias("_row")).agg(
            F.sum(F.round(F.when(F.col("odds") > 0, F.col("odds") * use).otherwise(F.col("odds")), 6)).alias("_sum"))
        rows = rows.join(held, F.col("row") == F.col("_row"), "left")
        sums = F.coalesce("_sum", F.lit(0.0))
    place = F.greatest(F.least(F.round((F.round(sums, 4) - LOW) / STEP), F.lit(100.0)), F.lit(0.0)).cast("int")
    rows = written(rows.select("doc_id", "y", place.alias("at")), "toxic-evidence")
    counts = rows.where("y is not null").groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()  # 101 rows at most
    table = score_table({r["at"]: (r["n"], r["y"]) for r in counts}) if counts else [0.0] * 101
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
    value = F.element_at(F.array(*[F.lit(v) for v in table]), F.col("at") + 1)
    return rows.select("doc_id", held_out.alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))
