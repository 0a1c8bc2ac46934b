import math
import random
from collections import Counter, defaultdict

import pytest

from lanewise.llm.kneser_ney import fit, score


def words_of(text):
    return (text or "").encode().lower().split()


class Plain:
    """Interpolated modified Kneser-Ney from dictionaries of n-grams."""

    def __init__(self, texts, order):
        self.order = order
        raw = [Counter() for _ in range(order + 1)]
        for t in texts:
            s = ["<s>", *words_of(t), "</s>"]
            for k in range(1, order + 1):
                raw[k].update(tuple(s[i : i + k]) for i in range(len(s) - k + 1) if k > 1 or i > 0)
        self.raw1 = raw[1]
        self.tokens = sum(raw[1].values())
        self.counts = [None] * (order + 1)
        self.counts[order] = raw[order]
        for k in range(order - 1, 0, -1):
            c = Counter()
            for g in raw[k + 1]:
                c[g[1:]] += 1
            if k > 1:
                for g, n in raw[k].items():
                    if g[0] == "<s>":
                        c[g] = n
            self.counts[k] = c
        self.d = [None] + [self.discounts(c) for c in self.counts[1:]]
        self.follow = [None] * (order + 1)
        for k in range(1, order + 1):
            f = defaultdict(lambda: [0, 0, 0, 0])
            for g, n in self.counts[k].items():
                f[g[:-1]][0] += n
                f[g[:-1]][min(n, 3)] += 1
            self.follow[k] = f

    @staticmethod
    def discounts(c):
        n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in range(1, 5))
        if not (n1 and n2 and n3):
            return (0, 0.5, 1.0, 1.5)
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        return (0, *d) if all(0 < x <= i for i, x in enumerate(d, 1)) else (0, 0.5, 1.0, 1.5)

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.raw1) + 1)
        f = self.follow[k].get(gram[:-1])
        if not f or not f[0]:
            return self.p(gram[1:])
        n, d = self.counts[k].get(gram, 0), self.d[k]
        gamma = sum(d[i] * f[i] for i in (1, 2, 3)) / f[0]
        return max(n - d[min(n, 3)], 0) / f[0] + gamma * self.p(gram[1:])

    def score(self, text):
        s = ["<s>", *words_of(text), "</s>"]
        return sum(math.log10(self.p(tuple(s[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(s)))

    def base(self, text):
        n = self.tokens + len(self.raw1) + 1
        return sum(math.log10((self.raw1.get((w,), 0) + 1) / n) for w in [*words_of(text), "</s>"])


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_dictionaries(spark, order):
    rng = random.Random(order)
    text = lambda: " ".join(rng.choices("the A b c Dd e f g h i".split(), [30, 20, 10, 8, 6, 5, 4, 3, 2, 1], k=rng.randrange(25)))
    train = [text() for _ in range(60)] + [None, ""]
    asked = train[:10] + [text() + " unseen words the b" for _ in range(10)] + [None, "", "new"]
    plain = Plain(train, order)
    model = fit(spark.createDataFrame([(t,) for t in train], "text string").repartition(3), "text", order)
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for r in score(docs, model, "doc_id", "text").collect():
        t = asked[r.doc_id]
        assert r.train_tokens == plain.tokens
        assert r.n_tokens == len(words_of(t)) + 1
        assert r.n_known == sum((w,) in plain.raw1 for w in [*words_of(t), "</s>"])
        assert r.base_score == pytest.approx(plain.base(t), rel=1e-9)
        assert r.score == pytest.approx(plain.score(t), rel=1e-5)


def test_sums_to_one(spark):
    train = ["a b c a b", "b c", "a", "c c c a"]
    model = fit(spark.createDataFrame([(t,) for t in train], "text string"), "text", 2)
    plain = Plain(train, 2)
    for context in ("a", "b", "c", "<s>"):
        known = sum(plain.p((context if context == "<s>" else context.encode(), *w)) for w in plain.raw1)
        assert known + plain.p((context if context == "<s>" else context.encode(), "?")) == pytest.approx(1)
    assert model.types == len(plain.raw1)


def test_documents(spark, documents):
    model = fit(documents, "text")
    rows = score(documents, model, "doc_id", "text").collect()
    assert len(rows) == documents.count()
    assert all(r.n_known == r.n_tokens and r.score < 0 for r in rows)
    empty = fit(documents.limit(0), "text")
    assert all(r.n_known == 0 and r.base_score == 0 for r in score(documents, empty, "doc_id", "text").collect())
    assert score(documents.limit(0), model, "doc_id", "text").count() == 0
