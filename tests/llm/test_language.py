"""Language model: seating weights against enumeration, scores against a plain customer-by-customer sampler."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridledger.llm import language
from tests.llm import cases

SCHEMA = "doc_id long, text string"


def test_messages_round_trip():
    rng = np.random.default_rng(0)
    columns = [rng.integers(-3, 3, 10), np.zeros(0, np.int64), np.array([2**40, -(2**62)]), np.arange(70_000)]
    for a, b in zip(columns, language.unpack(language.pack(*columns))):
        assert (a == b).all() and b.dtype == np.int64


def partitions(n):
    """Seatings of n customers, as block sizes of all set partitions."""
    if n == 0:
        yield []
        return
    for rest in partitions(n - 1):
        yield [*rest, 1]
        for i in range(len(rest)):
            yield [*rest[:i], rest[i] + 1, *rest[i + 1 :]]


@pytest.mark.parametrize("d", [0.2, 0.75])
def test_seatings_against_enumeration(d):
    table = language.log_seatings(d, 8)
    for c in range(1, 8):
        weight = defaultdict(float)
        for sizes in partitions(c):
            weight[len(sizes)] += math.prod(math.prod(j - d for j in range(1, s)) for s in sizes)
        for t in range(1, c + 1):
            assert table[c, t] == pytest.approx(math.log(weight[t]), abs=1e-9)


@pytest.mark.parametrize("d", [0.1, 0.5, 0.9])
def test_many_customers(d):
    exact = language.log_seatings(d, 512)
    for c in (257, 512):
        t = np.arange(1, c + 1)
        far = language.log_seatings_far(np.full(c, c, float), t.astype(float), d)
        own = exact[c, 1 : c + 1]
        gap = np.abs(far - own)
        assert gap[0] < 0.05 and gap[-1] < 0.01
        # Neighbouring weights, which decide a step, agree closely except for the first tables.
        assert np.abs(np.diff(far) - np.diff(own))[:-4].max() < 0.04


def test_log_gamma():
    x = np.array([0.05, 0.5, 1, 2.5, 7.9, 8, 100, 1e9])
    assert language.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-9)


def weights(c, others, parent, d, strength):
    log = language.log_seatings(d, c)[c, 1:]
    rise = np.cumsum(np.log(strength + d * (others + np.arange(c))) + math.log(parent))
    odds = np.exp(log + rise - (log + rise).max())
    return odds / odds.sum()


def test_draws_follow_the_conditional():
    rng = np.random.default_rng(1)
    settings = language.Settings()
    for c, others, parent in ((2, 0, 0.5), (5, 30, 0.01), (40, 1000, 0.05)):
        n = 20_000
        t = language.draw_tables(np.full(n, c), np.full(n, float(others)), np.full(n, parent), 0.7, settings, rng)
        wanted = weights(c, others, parent, 0.7, settings.strength)
        assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - wanted).max() < 0.02


def test_steps_follow_the_conditional():
    rng = np.random.default_rng(2)
    settings = language.Settings(exact=8, steps=60)
    for others, parent in ((1000, 0.05), (5000, 0.004)):
        n, c = 4000, 300
        t = language.draw_tables(np.full(n, c), np.full(n, float(others)), np.full(n, parent), 0.7, settings, rng)
        wanted = weights(c, others, parent, 0.7, settings.strength)
        mean = (wanted * np.arange(1, c + 1)).sum()
        assert t.mean() == pytest.approx(mean, rel=0.05)


def test_predictions_sum_to_one():
    rng = np.random.default_rng(3)
    n = 50
    customers = rng.integers(1, 20, n)
    tables = np.minimum(customers, rng.integers(1, 4, n))
    model = language.Model(n, 1000, 0.6, 0.4, 1.0)
    parent = model.parent(np.append(customers, 0), np.append(tables, 0), (customers.sum(), tables.sum()))
    assert parent.sum() == pytest.approx(1)
    c = np.append(rng.integers(0, 3, n), 0)
    t = np.minimum(c, 1)
    assert model.predict(c, t, c.sum(), t.sum(), parent).sum() == pytest.approx(1)


def tokens(text):
    return (text or "").encode().lower().split()


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def contract(rows):
    """Columns the contract fixes, per row."""
    seen = Counter()
    for i, text in rows:
        if not held(i):
            seen.update([*tokens(text), b""])
    n, v = sum(seen.values()), len(seen)
    out = []
    for i, text in rows:
        own = [*tokens(text), b""]
        base = sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        out.append((-1 if i is None else i, held(i), len(own), sum(seen[w] > 0 for w in own), n, round(base, 6)))
    return sorted(out)


def fixed(frame):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    return sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in names[1:-1]), round(r["base_score"], 6))
        for r in frame.select(*names).collect()
    )


def corpus(n, seed):
    """Texts of a chain in which each word has few successors."""
    rnd = random.Random(seed)
    words = cases.WORDS
    after = {w: [rnd.choice(words) for _ in range(3)] for w in words}
    out = []
    for i in range(n):
        text = [rnd.choice(words)]
        for _ in range(rnd.randrange(1, 60)):
            text.append(rnd.choice(after[text[-1]]) if rnd.random() < 0.9 else rnd.choice(words))
        out.append((i, " ".join(text)))
    return out


def plain_sampler(rows, model, strength, sweeps, burn_in, seed):
    """Chinese restaurants with customers seated one by one; log10 scores by row."""
    rnd = random.Random(seed)
    pairs = []
    for i, text in rows:
        if not held(i):
            own = [*tokens(text), b""]
            pairs += list(zip([b"", *own[:-1]], own))
    levels = [defaultdict(lambda: defaultdict(list)), defaultdict(lambda: defaultdict(list))]  # restaurant, dish: tables

    def chance(level, key, w):
        if level < 0:
            return 1 / (model.known + 1)
        d = (model.d_root, model.d)[level]
        own = levels[level][key]
        size, tables = sum(map(sum, own.values())), sum(map(len, own.values()))
        up = chance(level - 1, None, w)
        return (sum(own[w]) - d * len(own[w]) + (strength + d * tables) * up) / (strength + size)

    def sit(level, key, w):
        d = (model.d_root, model.d)[level]
        own = levels[level][key]
        tables = sum(map(len, own.values()))
        odds = [n - d for n in own[w]] + [(strength + d * tables) * chance(level - 1, None, w)]
        at = rnd.choices(range(len(odds)), odds)[0]
        if at == len(own[w]):
            own[w].append(1)
            if level:
                sit(level - 1, None, w)
        else:
            own[w][at] += 1

    def leave(level, key, w):
        own = levels[level][key][w]
        at = rnd.choices(range(len(own)), own)[0]
        own[at] -= 1
        if not own[at]:
            del own[at]
            if level:
                leave(level - 1, None, w)

    for u, w in pairs:
        sit(1, u, w)
    distinct = {(u, w) for i, text in rows for u, w in zip([b"", *tokens(text)], [*tokens(text), b""])}
    odds = Counter()
    for sweep in range(sweeps):
        for u, w in pairs:
            leave(1, u, w)
            sit(1, u, w)
        if sweep >= burn_in:
            for u, w in distinct:
                odds[u, w] += chance(1, u, w)
    kept = sweeps - burn_in
    return {
        i: sum(math.log10(odds[u, w] / kept) for u, w in zip([b"", *tokens(text)], [*tokens(text), b""])) for i, text in rows
    }


def test_scores_against_plain_sampler(spark):
    rows = corpus(40, 8)
    settings = language.Settings(burn_in=3, samples=6, parts=3)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: r["score"] for r in language.score(frame, settings).collect()}
    pairs = Counter()
    words = Counter()
    for i, text in rows:
        if not held(i):
            own = [*tokens(text), b""]
            words.update(own)
            pairs.update(zip([b"", *own[:-1]], own))
    discounts = [
        language.discount(sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())) for c in (pairs, words)
    ]
    model = language.Model(len(words), sum(words.values()), *discounts, settings.strength)
    wanted = plain_sampler(rows, model, settings.strength, 40, 10, 4)
    whole = sum(len(tokens(t)) + 1 for _, t in rows)
    assert sum(got.values()) / whole == pytest.approx(sum(wanted.values()) / whole, abs=0.01)
    for i, text in rows:
        assert got[i] == pytest.approx(wanted[i], abs=0.05 * (len(tokens(text)) + 1))


def test_learns_from_context(spark):
    rows = corpus(300, 9)
    out = language.score(spark.createDataFrame(rows, SCHEMA)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.8 * out[1]  # both are negative


@pytest.mark.parametrize("parts, block, row", [(1, 1 << 21, 1 << 15), (5, 250, 7)])
def test_contract_columns(spark, parts, block, row):
    rows = [(i, t) for i, t in corpus(120, 10)] + [(500, None), (501, ""), (502, " \t\n\x0b\x0c\r "), (503, "É é  A B a")]
    rows += [rows[0], (None, rows[1][1]), (30, "unheard of"), (504, "the " * 5000)]
    settings = language.Settings(parts=parts, block_bytes=block, row=row, state_row=row)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = language.score(frame, settings).cache()
    assert fixed(out) == contract(rows)
    assert out.filter("score IS NULL OR isnan(score) OR score > 0").count() == 0
    out.unpersist()


def test_many_customers_at_one_dish(spark):
    """A pair seen far more often than `exact` and one word that holds nearly all tokens."""
    rows = [(i, "a a a a a a a a b") for i in range(500)] + [(1000, "b b c")]
    out = {r["doc_id"]: r["score"] for r in language.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    # E a, a a (7 times), a b, b E: frequencies 1, 7/8, 1/8 and 1.
    assert out[0] == pytest.approx(7 * math.log10(7 / 8) + math.log10(1 / 8), abs=0.05)


@pytest.mark.parametrize("extra", ["", "held", "score"])
def test_awkward_rows(spark, extra):
    docs = cases.awkward(spark, extra)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert fixed(language.score(docs)) == contract(rows)


def test_empty_and_untrained(spark):
    assert language.score(cases.empty(spark)).count() == 0
    held_out = next(i for i in range(100) if held(i))
    row = language.score(spark.createDataFrame([(held_out, "a b")], SCHEMA)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["score"]) == (3, 0, 0, 0)
    assert row["base_score"] == pytest.approx(0)
