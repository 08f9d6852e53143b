import math
import random
import re

import numpy as np

from marlstone.llm import quality_rules as Q


def slow_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(win) if win.count(w) > 1 for j in (i, i + 1, i + 2)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(lines)


def test_base_stats_equal_slow_form():
    rng = random.Random(3)
    texts = [None, "", " \n\x0b", "a", "a b c a b c", "a a a a a", "x\ny\nx\n\nx \n#*é ü|", "a b c d"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d# ", "é\t"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    for t in texts:
        got = Q.base_stats(t)
        want = slow_stats(t)
        assert got == (want if want[0] else (0,) * 6), t


def integral(x, k):
    """Chi-square distribution function by adding up its density."""
    t = np.linspace(0, x, 400_001)
    f = t ** (k / 2 - 1) * np.exp(-t / 2)
    return float(((f[1:] + f[:-1]) / 2).sum() * t[1] / (2 ** (k / 2) * math.gamma(k / 2)))


#: Quantiles of the chi-square distribution with five degrees of freedom, from tables.
CHI = {0.75: 6.6257, 0.975: 12.8325}
LEAST = np.array([600.0, 60.0, 700.0, 1300.0, 1000.0])


def well_posed(cov):
    """Lift small deviations, then mix in the diagonal until the condition number is 100, by halving."""
    cov = cov.copy()
    for i in range(5):
        cov[i, i] = max(cov[i, i], LEAST[i] ** 2)
    s = np.sqrt(np.diag(cov))
    r = cov / s[:, None] / s[None, :]
    mixed = lambda rho: (1 - rho) * r + rho * np.eye(5)
    condition = lambda rho: np.linalg.svd(mixed(rho), compute_uv=False)[[0, -1]]
    good = lambda rho: condition(rho)[0] <= 100 * condition(rho)[1]
    lo, hi = 0.0, 1.0
    if good(0.0):
        hi = 0.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if good(mid) else (mid, hi)
    return mixed(hi) * s[:, None] * s[None, :]


def slow_mcd(x):
    """The same estimate for one group of integer points, in NumPy alone: (centre, inverse scatter, log-determinant) by start."""
    n = len(x)

    def fit(sub, share):
        m = sub.mean(0)
        cov = (sub - m).T @ (sub - m) / len(sub)
        if share < 1:
            cov *= share / integral(CHI[share], 7)
        cov = well_posed(cov)
        root = np.linalg.cholesky(cov)  # fails where it is not positive definite
        return m, np.linalg.solve(cov, np.eye(5)), 2 * np.log(np.diag(root)).sum()

    def d2(m, p):
        d = x - m
        return np.einsum("ij,jk,ik->i", d, p, d)

    q = np.percentile(x, [25, 50, 75], axis=0)
    scale = np.maximum((q[2] - q[0]) / 1.349, LEAST)
    u = (x - q[1]) / scale
    u = np.floor(10_000 * u / np.maximum(np.linalg.norm(u, axis=1), 1e-9)[:, None] + 0.5)
    signs = u.T @ u / n / 1e8 + 0.05 * np.eye(5)
    starts = [(q[1], np.diag(1 / scale**2)), fit(x.astype(float), 1)[:2], (q[1], np.linalg.inv(signs) / np.outer(scale, scale))]
    found = []
    for m, p in starts:
        was = np.inf
        while True:
            b = np.floor(32 * np.log2(d2(m, p) + 1e-6))
            new = fit(x[b <= np.sort(b)[int(np.ceil(n * 0.75)) - 1]].astype(float), 0.75)
            if not new[2] < was - 1e-9:
                break
            m, p, was = new
        found.append((was, m, p))
    _, m, p = min(found, key=lambda f: f[0])
    m, p, _ = fit(x[d2(m, p) <= CHI[0.975]].astype(float), 0.975)
    return m, p, [f[0] for f in found]


def test_chi_square():
    assert abs(Q.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(Q.chi2_quantile(0.975, 5) - 12.8325) < 1e-3


def test_mcd_equals_slow_form(spark):
    rng = np.random.default_rng(5)
    rows, groups = [], {}
    for g, n in (("a", 400), ("b", 90), ("c", 200)):
        x = np.round(rng.normal([5000, 5000, 0, 0, 0], [900, 300, 50, 2000, 1900], (n, 5))).astype(int)
        x[: n // 5, 1] += 3000
        if g == "c":  # outliers in a dense lump, where starts may end in different places
            x[: n // 5] = np.round(rng.normal([9000, 9000, 5000, 9000, 9000], 40, (n // 5, 5))).astype(int)
        groups[g] = x
        rows += [(g, *map(int, r)) for r in x]
    groups["d"] = groups["a"][100:103]
    groups["two points"] = np.repeat(groups["a"][:2], [40, 30], axis=0)
    groups["one point"] = np.repeat(groups["a"][:1], 60, axis=0)
    groups["two clusters"] = np.array([[4000, 4000, 0, 0, 0]] * 3 + [[9000, 9000, 5000, 4000, 4000]] * 2)
    groups["collinear"] = groups["a"].copy()
    groups["collinear"][:, 4] = groups["collinear"][:, 3] = 2 * groups["collinear"][:, 0]
    rows += [(g, *map(int, r)) for g in list(groups)[3:] for r in groups[g]]
    got = {r.grp: r for r in Q.mcd(spark.createDataFrame(rows, "grp string, " + ", ".join(f"{c} long" for c in Q.FEATURES)).repartition(5)).collect()}
    assert len(got) == 8
    for g, x in groups.items():
        m, p, dets = slow_mcd(x)
        assert np.allclose(got[g].m, m, rtol=1e-9) and np.allclose(np.reshape(got[g].p, (5, 5)), p, rtol=1e-3, atol=1e-12), (g, dets)
        d = x - np.array(got[g].m)
        far = np.einsum("ij,jk,ik->i", d, np.reshape(got[g].p, (5, 5)), d)
        assert (far > 25.74).mean() <= (0.25 if g in "abc" else 0.2)
        if g in ("two points", "one point", "two clusters"):
            assert far.max() < 25.74
        if g in "ab":
            assert abs(m[1] - 5000) < 100  # a fifth of outliers doesn't move the centre


def test_few_and_repeated_texts_are_kept(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    one, two = (" ".join(word() for _ in range(n)) for n in (80, 400))
    kept = lambda texts: [r.kept for r in Q.quality_rules(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()]
    for texts in ([one], [one, two], [one] * 40 + [two] * 30, [one] * 3 + [two + " | $"] * 2, [one] * 200):
        assert kept(texts) == [True] * len(texts)


def test_quality_rules(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    good = [(i, " ".join(word() for _ in range(rng.randint(60, 200))), "en", "s", 1) for i in range(150)]
    junk = [(1000, " | ".join(word() for _ in range(90)), "en", "s", 1), (1001, "x y z " * 60, "en", "s", 1), (1002, None, None, None, 1), (1003, "few words", "en", None, 1), (None, None, None, None, 1)]
    rare = [(2000 + i, " ".join(word() for _ in range(70)), None, "r", 1) for i in range(3)]
    df = spark.createDataFrame(good + junk + rare + rare[:1], "doc_id long, text string, lang string, source string, kept int")
    got = {r.doc_id: r for r in Q.quality_rules(df).collect()}
    assert sum(got[i].kept for i in range(150)) == 150
    assert not got[1000].kept and not got[1000].base_failed and got[1001].base_failed and got[1002].n_words == 0 and not got[1003].kept
    assert got[2000].kept and got[2000].distance2 > 0  # a small pool is judged by the estimate of all
    alone = Q.quality_rules(df.where("doc_id >= 2000")).collect()
    assert len(alone) == 4 and all(r.kept for r in alone)
    huge = spark.createDataFrame([(9, "x" * 3_000_000 + " a b" * 60, "en", "s", 1)], df.schema)
    assert not {r.doc_id: r.kept for r in Q.quality_rules(df.unionByName(huge)).collect()}[9]
    assert Q.quality_rules(df).count() == df.count() and Q.quality_rules(df.limit(0)).count() == 0
    kept = Q.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 150 + 4 + 1


def test_few_groups_are_combined_in_one_task(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"g{i % 5}", *(rng.randint(0, 9000) for _ in Q.FEATURES)) for i in range(600)]
    points = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{c} long" for c in Q.FEATURES)).repartition(5)
    shuffles, write = [], Q.materialise
    monkeypatch.setattr(Q, "materialise", lambda df, label: shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(")) or write(df, label))
    few = sorted(map(tuple, Q.mcd(points).collect()))
    assert max(shuffles[2:]) <= 3  # after quartiles and starts: moments are dealt once, not again for the steps' order; then estimates are joined
    monkeypatch.setattr(Q, "GATHERED", 0)
    assert sorted(map(tuple, Q.mcd(points).collect())) == few and len(few) == 5
