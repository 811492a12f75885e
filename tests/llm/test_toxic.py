import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from riskweave.llm import op13_toxic as op
from riskweave.llm import registry
from riskweave.llm.common import table

from .helpers import docs, table_rows

SF = "/root/testdata/sf0.1"


def edits(a, b):
    """Edits with swaps of neighbours (a swapped pair is not edited again)."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def brute_matches(text, terms):
    """(form, term, edits, use) of a text: every token against every term."""
    text = text.lower()
    toks = [(m.start(), m.end()) for m in re.finditer(r"(?:[^\W\d_]|(?<=[^\W\d_])[0-9@$*!]{1,2}(?=[^\W\d_]))+", text)]
    words = [text[a:b] for a, b in toks]
    out = []
    for k, w in enumerate(words):
        best = min(((edits(w, t), i) for i, t in enumerate(terms) if abs(len(w) - len(t)) <= 2 and edits(w, t) <= op.budget(len(t))), default=None)
        if not best or (best[0] and w in op.MENTIONS + op.ADDRESSES):
            continue
        a, b = toks[k]
        lo = max(text.rfind("\n", 0, a), text.rfind("\r", 0, a)) + 1
        hi = min(x for x in (text.find("\n", b), text.find("\r", b), len(text)) if x >= 0)
        quotes = lambda s: sum(c in op.QUOTES for c in s)
        near = words[max(0, k - op.WINDOW):k + op.WINDOW + 1]
        use = (0 if quotes(text[lo:a]) % 2 and quotes(text[b:hi]) or text[lo:lo + 1] == ">" else 1 if set(near) & set(op.MENTIONS)
               else 2 if set(near) & set(op.ADDRESSES) else 3)
        out.append((w, best[1], best[0], use))
    return out


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    terms = list(dict.fromkeys([word(rng.randint(2, 10)) for _ in range(25)]))
    find = op.Finder(terms)
    tokens = [word(rng.randint(1, 12)) for _ in range(1500)]
    for t in terms:
        for _ in range(20):
            w = list(t)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w) + 1)
                w[at:at + rng.randint(0, 2)] = word(rng.randint(0, 2))
            i = rng.randrange(len(t))
            tokens += ["".join(w) or "a", t[:i] + t[i + 1:i + 2] + t[i:i + 1] + t[i + 2:]]
    got = {(tokens[d], form, term, e) for d, form, term, e, _ in find(tokens)}
    want = set()
    for w in tokens:
        best = min(((edits(w, t), i) for i, t in enumerate(terms) if edits(w, t) <= op.budget(len(t))), default=None)
        if best:
            want.add((w, w, best[1], best[0]))
    assert got == want


TEXTS = ["you idiot", "an IDIOT's", "id1ot id!ot i**ot idi0t$$$", "he said \"such an idoit\" and left", "the word idiot is", "> idiot you\nidiot",
         "idiot " * 30, "", " ", "“worthles” worthlesss wortless\nworthless \"x", "idi\not", "İdiot idiots", "1idiot2", "éidiot 漢idiot"]


def test_matches_equal_brute_force(spark):
    terms = ["idiot", "worthless", "trash", "ab", "ödland"]
    rng = random.Random(2)
    texts = TEXTS + [(r["text"] or "")[:1500] for r in table_rows("documents")[:120]]
    pool = terms + op.MENTIONS[:5] + op.ADDRESSES[:5] + ["trsah", "odland", "worthlss", "b", "\"", "\"", "»", "\n", ">", "wood", "x1y"]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    got = defaultdict(list)
    for d, *m in op.Finder(terms)(texts):
        got[d].append(tuple(m))
    assert [got[d] for d in range(len(texts))] == [brute_matches(t, terms) for t in texts]
    rows = op.matches(docs(spark, list(enumerate(texts))), terms).collect()
    assert sorted((r["doc_id"], r["form"], r["term"], r["edits"], r["n0"], r["n1"], r["n2"], r["n3"]) for r in rows if r["form"]) == sorted(
        (d, *k, *(Counter(m[3] for m in got[d] if m[:3] == k)[u] for u in range(4))) for d in got for k in {m[:3] for m in got[d]})


def planted(n=900, seed=5):
    """(documents, labels): toxic ones use terms, often misspelt; clean ones may quote them or hold a word that looks like one."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    bad = ["worthless", "pathetic", "scumbag", "moronic", "vermin"]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        kind = rng.random()
        if kind < 0.25:
            for _ in range(4):
                w = list(rng.choice(bad))
                if rng.random() < 0.3:
                    w[rng.randrange(len(w))] = rng.choice("xyz0")
                text[rng.randrange(len(text))] = "".join(w)
        elif kind < 0.45:
            at = rng.randrange(len(text))
            text[at] = f'he said "such a {rng.choice(bad)} thing" there'
        elif kind < 0.75:
            text[rng.randrange(len(text))] = "vermit"  # a word of its own
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind < 0.25)))
    return rows, labels


def taught(labels):
    return {i: y for i, y in labels if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5}


def brute_scores(rows, labels, terms):
    """Scores from the definition, given the learned terms."""
    known = taught(labels)
    per = {}
    for i, t in rows:
        forms = defaultdict(set)
        for form, term, e, use in brute_matches(t or "", [w for w, _ in terms]):
            forms[form, term, e].add(use)
        per[i] = forms
    t1, t0 = (sum(known[i] == y for i in per if i in known) for y in (1, 0))
    scale, n = t0 / t1, defaultdict(lambda: [0, 0])
    for i, forms in per.items():
        for f in forms:
            if i in known:
                n[f][known[i]] += 1
    faith = op.FORM_FAITH * (1 + scale) / 2
    share = lambda prior, c: (faith * prior + scale * c[1]) / (faith + scale * c[1] + c[0])
    first = lambda f: terms[f[1]][1] * op.EDIT_PRIORS[f[2]]
    kin = defaultdict(list)
    for f, c in n.items():
        if f[2]:
            kin[f[1:]].append(share(first(f), c))
    weights = []
    for u, w in enumerate(op.USE_WEIGHTS):
        c = [sum(any(f[2] == 0 and u in uses for f, uses in per[i].items()) for i in per if known.get(i) == y) for y in (0, 1)]
        weights.append((op.USE_FAITH * w + scale * c[1]) / (op.USE_FAITH + scale * c[1] + c[0]))
    places = {}
    for i, forms in per.items():
        total = 0.0
        for f, uses in forms.items():
            c = [n[f][y] - (known.get(i) == y) for y in (0, 1)] if f in n else [0, 0]
            prior = (op.FORM_FAITH * first(f) + sum(kin[f[1:]])) / (op.FORM_FAITH + len(kin[f[1:]])) if f[1:] in kin else first(f)
            p = share(prior, c)
            odds = op.SUREST if p >= 1 else max(-op.SUREST, min(op.SUREST, math.log(p / (1 - p))))
            total += odds * max(weights[u] for u in uses) if odds > 0 else odds
        places[i] = (round(total, 4) - op.LOW) / op.STEP
    rounded = {i: max(0, min(100, math.floor(x + 0.5))) for i, x in places.items()}
    counts = defaultdict(lambda: (0, 0))
    for i, k in rounded.items():
        if i in known:
            counts[k] = (counts[k][0] + 1, counts[k][1] + known[i])
    scores = op.score_table(counts)
    return {i: scores[k] for i, k in rounded.items()}


def test_planted_cases_and_brute_force(spark):
    rows, labels = planted()
    d, y = docs(spark, rows), spark.createDataFrame([(i, v, "x", 0.5) for i, v in labels], "doc_id long, toxic int, text string, score double")
    got = {r["doc_id"]: r for r in op.score(d, y).collect()}
    terms = op.lexicon(d, op.trained_on(y, "doc_id", "toxic"), "doc_id", "text", op.TRAIN_ROWS, op.MAX_TERMS)
    assert {t for t, _ in terms} == {"worthless", "pathetic", "scumbag", "moronic", "vermin"}
    assert {i: r["score"] for i, r in got.items()} == pytest.approx(brute_scores(rows, labels, terms), abs=2e-6)
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(held) == sorted(i for i, r in got.items() if r["held_out"])
    wrong = [i for i, v in labels if i in set(held) and got[i]["predicted"] != v]
    assert len(wrong) <= 0.02 * len(held)


def test_score_table_is_monotone():
    rng = random.Random(3)
    for _ in range(20):
        counts = {k: (n, rng.randint(0, n)) for k in rng.sample(range(101), 30) for n in [rng.randint(1, 50)]}
        values = op.score_table(counts)
        assert len(values) == 101 and values == sorted(values) and 0 <= values[0] and values[-1] <= 1


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in registry.queries()["op13_toxic_automata"](spark, SF).collect()}
    assert len(got) == 10_000
    known = {r["doc_id"]: r["toxic"] for r in table_rows("labels", SF)}
    held = [(known[i], r) for i, r in got.items() if r["held_out"] and i in known]
    caught = [r["predicted"] for y, r in held if y]
    falsely = [r["predicted"] for y, r in held if not y]
    assert sum(caught) > 0.88 * len(caught) and sum(falsely) < 0.02 * len(falsely)


def test_awkward_rows_and_tables(spark):
    rows = [(1, None), (2, ""), (3, "idiot"), (4, "idiot " * 30_000), (5, "x" * 300_000), (None, "idiot"), (3, "again the idiot"), (6, "ıİß 漢字")]
    d = docs(spark, rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = op.score(d, none, extra_terms=("Idiot",)).collect()
    assert len(got) == len(rows) and {(r["score"], r["predicted"]) for r in got} == {(0.0, 0)}
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 0), (3, 1), (3, 0), (4, 1), (5, 0), (6, 0), (77, 1)], "doc_id long, toxic int")
    got = op.score(d, odd, extra_terms=("Idiot",)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert op.score(docs(spark, []), odd).collect() == []
