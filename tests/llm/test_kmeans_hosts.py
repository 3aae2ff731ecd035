import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docshelf.llm import ns_kmeans as K
from docshelf.llm.host_reputation import RULES, ReputationOptions, Rule, host_scores, judge_pages, rule_of, url_host, url_path, with_site
from docshelf.llm.q_pages import document_of_page, page_outcomes

from ..conftest import SF_SMALL

DDL = "vec_id bigint, embedding array<double>, cluster int, comps string, wide int, d string, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "y", 3) for i, v in rows], DDL).repartition(3)


def lloyd(rows, o):
    """Plain k-means on integers, every distance in every round."""
    kept = [(i, [math.floor(o.scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == o.dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{o.seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()
                     if max(map(abs, r[1])) < K.EXACT else b"")
    centroids = [v for _, v in sorted(kept, key=key)[:o.k]]
    for r in range(o.rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r < o.rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, c) in zip(kept, near) if c == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    part = {j: sum(d for d, c in near if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda n: n if n < 1 << 63 else None
    return sorted(((i, c, fits(d), fits(part[c]), fits(sum(part.values())), sha[c]) for (i, _), (d, c) in zip(kept, near)), key=repr)


def same(spark, rows, o):
    got = sorted((tuple(x) for x in K.cluster_vectors(vectors(spark, rows), opts=o).collect()), key=repr)
    assert got == lloyd(rows, o)


def test_clusters_match_plain_kmeans(spark):
    r = np.random.default_rng(2)
    middle = r.standard_normal((6, 8)) * 2
    rows = [(k, (middle[k % 6] + r.standard_normal(8) * 0.6).tolist()) for k in range(400)]
    same(spark, rows, K.ClusterOptions(k=12, rounds=5, dim=8))


def test_odd_vectors_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, nan]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, [0.0]), (7, [0.0, 0.0, 0.0])]
    rows += [(10 + k, [float(k % 3 - 1), 0.0]) for k in range(12)] + [(40, [0.5, 0.5])] * 3 + [(None, [0.25, -0.125])]
    rows += [((1 << 60) + 1, [0.001, -0.001])]
    for k in (1, 3, 50):
        same(spark, rows, K.ClusterOptions(k=k, rounds=3, dim=2))
    assert K.cluster_vectors(vectors(spark, []), opts=K.ClusterOptions(dim=2)).count() == 0
    assert K.cluster_vectors(vectors(spark, rows[:7]), opts=K.ClusterOptions(dim=2)).count() == 0


def test_vectors_far_beyond_64_bits(spark):
    r = random.Random(4)
    rows = [(k, [r.uniform(-1, 1) * 10 ** r.choice([0, 3, 9, 20, 38]) for _ in range(3)]) for k in range(60)]
    o = K.ClusterOptions(k=5, rounds=4, dim=3)
    starts = sorted(range(60), key=lambda k: hashlib.sha256(f"2:{k}".encode()).hexdigest())
    assert len(set(starts)) == 60
    same(spark, rows, o)


def test_bounds_spare_most_pairs_and_are_tighter_than_summed_drifts():
    r = np.random.default_rng(1)
    x = np.floor(r.standard_normal((2000, 16)) * 20 + r.integers(0, 8, 2000)[:, None] * 100).astype(np.int64)
    history = [x[r.permutation(2000)[:20]].tolist()]
    cluster, seen, at = np.full(2000, -1), np.zeros((2000, 20), np.float32), np.zeros((2000, 20), np.uint16)
    pairs, drifts = [], []
    for _ in range(8):
        cluster, d, n = K.assign(x, cluster, seen, at, history, K.displacements(history))
        all_d = ((x[:, None] - np.array(history[-1])[None]) ** 2).sum(2)
        assert (cluster == all_d.argmin(1)).all() and (d == all_d.min(1)).all()
        pairs.append(n)
        history.append([(x[cluster == j].sum(0) // (cluster == j).sum()).tolist() if (cluster == j).any() else c
                        for j, c in enumerate(history[-1])])
        drifts.append([math.dist(a, b) for a, b in zip(history[-2], history[-1])])
    assert pairs[0] == 2000 * 20 and pairs[-1] < pairs[0] / 4
    total = K.displacements(history)
    assert (total[0] <= np.sum(drifts, axis=0) * (1 + 1e-9) + 1e-9).all() and (total[0] < np.sum(drifts, axis=0)).any()


def test_scratch_tables_are_dropped(spark):
    import glob

    from docshelf.session import ensure_checkpoint_dir

    before = set(glob.glob(ensure_checkpoint_dir(spark).removeprefix("file:") + "/llm-ns-*"))
    rows = [(k, [float(k % 7), 1.0]) for k in range(50)]
    K.cluster_vectors(vectors(spark, rows), opts=K.ClusterOptions(k=4, dim=2)).count()
    left = set(glob.glob(ensure_checkpoint_dir(spark).removeprefix("file:") + "/llm-ns-*")) - before
    assert len(left) == 1        # the result


# ---- host reputation

URLS = [None, "", "no scheme", "http://", "http://A.Example.NET", "https://a.example.net/en/1?x=1#t", "http://x.net?q=/en/",
        "ftp://USER@Host.example.com:80/de/a#b", "http://net/x", "http://subnet/x", "http://a.b://c/d", "http://ÄB.org/fr/é",
        "http://h\n.org/fr/\nx", "http://" + "a" * 300_000 + ".net/" + "7" * 300_000 + "/x", "x://org/fr/" + "/" * 300_000]


def plain_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("#")[0].split("?")[0]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fit, key=lambda r: (-len(r.text), r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_hosts_paths_and_rules(spark):
    rules = [*RULES, Rule("allow", "subnet", "/"), Rule("block", "b", "/d"), Rule("allow", "c", "/e")]
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    got = df.select("url", host.alias("h"), path.alias("p"), rule_of(host, path, rules).alias("r")).collect()
    for x in got:
        assert (x.h, x.p, x.r and x.r.rule, x.r and x.r.verdict) == plain_judge(x.url, rules)


def test_domains_and_suffixes(spark):
    want = {"www.example.com": ("example.com", "com"), "example.com": ("example.com", "com"), "com": ("com", "com"), "": ("", ""),
            "a.b.example.co.uk": ("example.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.net.xyz": ("net.xyz", "xyz"),
            "u:p@www.example.com:8080": ("example.com", "com"), "10.1.2.3": ("10.1.2.3", "10.1.2.3"), "example.com.": ("example.com", "com")}
    df = with_site(spark.createDataFrame([(h,) for h in want], "host string"), ReputationOptions())
    assert {x.host: (x.domain, x.suffix) for x in df.collect()} == want


def brute_scores(counts, o):
    """Posterior of each host by the same model in plain Python; ``counts[host] = (domain, suffix, n, bad)``."""
    def up(groups, key):
        out = {}
        for g, (n, b) in groups.items():
            m, c = out.get(key(g), (0, 0))
            out[key(g)] = (m + n, c + b)
        return out

    hosts = {h: (n, b) for h, (_, _, n, b) in counts.items()}
    parent = {h: d for h, (d, _, _, _) in counts.items()}
    above = {d: s for d, s, _, _ in counts.values()}
    domains = up(hosts, parent.get)
    suffixes = up(domains, above.get)

    def strength(groups, prior):
        over = sum((b - n * prior[g]) ** 2 - n * prior[g] * (1 - prior[g]) for g, (n, b) in groups.items())
        most = sum(n * (n - 1) * prior[g] * (1 - prior[g]) for g, (n, b) in groups.items())
        rho = over / most if most else 0.0
        return 1 / min(max(rho, 1 / (1 + o.strongest)), 1 / (1 + o.weakest)) - 1

    n, b = map(sum, zip(*suffixes.values()))
    prior = {s: (b + 0.5) / (n + 1) for s in suffixes}
    for groups, names in ((suffixes, above), (domains, parent), (hosts, None)):
        s = strength(groups, prior)
        mean = {g: (b + s * prior[g]) / (n + s) for g, (n, b) in groups.items()}
        if names is not None:
            prior = {child: mean[g] for child, g in names.items()}
    return {h: (mean[h], mean[h] - math.sqrt((1 - o.miss) / o.miss * mean[h] * (1 - mean[h]) / (hosts[h][0] + s + 1))) for h in hosts}


def test_scores_match_the_model_and_shrink_level_by_level(spark):
    r = random.Random(8)
    rows, counts = [], {}
    for d in range(30):
        domain, suffix = f"d{d}.{['com', 'org', 'xyz'][d % 3]}", ["com", "org", "xyz"][d % 3]
        for h in range(r.randrange(1, 6)):
            n = r.choice([0, 1, 3, 40])
            bad = sum(r.random() < (0.95 if d % 3 == 2 else 0.05) for _ in range(n))
            rows.append((f"h{h}.{domain}", n, bad))
            counts[f"h{h}.{domain}"] = (domain, suffix, n, bad)
    seen = spark.createDataFrame(rows, "host string, n bigint, bad bigint")
    got = {x.host: x for x in host_scores(seen).collect()}
    want = brute_scores(counts, ReputationOptions())
    for h, (mean, bound) in want.items():
        assert got[h].mean == pytest.approx(mean, rel=1e-9) and got[h].bound == pytest.approx(bound, rel=1e-9)
        assert got[h].blocked == (bound > 0.5)
    unseen = [h for h, (_, _, n, _) in counts.items() if n == 0]
    assert {got[h].mean > 0.5 for h in unseen if h.endswith("xyz")} == {True}
    assert {got[h].mean < 0.5 for h in unseen if not h.endswith("xyz")} == {True}
    assert any(got[h].blocked for h in got if h.endswith("xyz")) and not any(got[h].blocked for h in got if not h.endswith("xyz"))


def test_pages_with_a_hot_host_nulls_repeats_and_clashing_columns(spark):
    ddl = "page_id bigint, url string, host string, path string, bad int, n int, rule string, row_key int, outcome_key string"
    rows = [(k, f"http://hot.bad.com/en/{k}") for k in range(300)] + [(1000 + k, f"http://w{k}.fine.org/de/{300 + k}") for k in range(300)]
    rows += [(5, "http://hot.bad.com/en/5"), (None, None), (None, "http://x.net/1"), (9, "")]
    pages = spark.createDataFrame([(*r, "h", "p", 1, 1, "r", 7, "k") for r in rows], ddl).repartition(4)
    labels = spark.createDataFrame([(k, 1, int(k < 300 and k % 10 > 0), "x") for k in range(600)] + [(None, 1, 0, "x"), (3, None, None, "x"), (4, 0, None, "x")],
                                   "doc_id bigint, quality int, toxic int, host string")
    out = judge_pages(pages, page_outcomes(labels), document_of_page(), RULES).collect()
    assert len(out) == len(rows)
    verdicts = {(x.page_id, x.host): (x.rule, x.verdict) for x in out}
    assert verdicts[5, "hot.bad.com"] == (None, "block") and verdicts[None, "x.net"] == ("net/", "block")
    assert verdicts[None, ""] == (None, "allow") and verdicts[9, ""] == (None, "allow")
    none = judge_pages(pages, page_outcomes(labels.limit(0)), document_of_page(), RULES)
    assert none.where("rule IS NULL AND verdict = 'block'").count() == 0
    assert judge_pages(pages.limit(0), page_outcomes(labels), document_of_page(), RULES).count() == 0


@pytest.mark.parametrize("name", ["op12_host_reputation", "op13_ns_kmeans"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from docshelf.llm.queries import ORACLE, QUERIES, load_all

    load_all()
    con = duckdb.connect()
    for t in ("pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = QUERIES[name](spark, SF_SMALL)
    want = con.sql(ORACLE[name])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall())) and got.columns == want.columns
