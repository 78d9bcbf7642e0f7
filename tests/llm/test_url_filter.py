from sentryspark.llm.url_filter import RULES, Rule, judged, propagated

KIND = "page_id long, url string, html string, host string, _bad string"


def verdicts(spark, rows, rules=RULES):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], KIND)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged(frame, rules).collect()}


def test_rules_and_parts(spark):
    found = verdicts(
        spark,
        [
            (1, "HTTP://WWW.Example.COM/en/x?q=/es/", ""), (2, "http://a.example.com/en/", None), (3, "http://a.example.com/fr/#/en/", ""), (4, "https://b.net/es/1", ""),
            (5, "https://c.org/es/1", ""), (6, None, None), (7, "no scheme", ""), (8, "x://", ""), (9, "x://h.com", ""), (10, "http://notexample.com/en/", ""), (11, "http://net/es/://x", ""),
        ],
    )
    assert found == {
        1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"), 3: ("a.example.com", "/fr/", "com/", "allow"), 4: ("b.net", "/es/1", "net/es/", "block"),
        5: ("c.org", "/es/1", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("h.com", "", None, "allow"), 10: ("notexample.com", "/en/", "com/", "allow"), 11: ("net", "/es/://x", "net/es/", "block"),
    }


def test_links_carry_trust_and_distrust(spark):
    link = "<a href='http://{}/'>x</a>".format
    rules = [Rule("good.com", "/", "allow"), Rule("bad.net", "/x/", "block")]
    rows = [
        (1, "http://good.com/1", link("praised.org")), (2, "http://bad.net/x/1", ""), (3, "http://accomplice.org/1", link("BAD.net") + link("bad.net")),
        (4, "http://praised.org/1", "<a HREF = //other.org/y>"), (5, "http://other.org/1", ""), (6, "http://bad.net/y/1", link("victim.org")), (7, "http://victim.org/", ""), (8, "http://farm.org/", link("accomplice.org")), (9, "http://mixed.org/", link("bad.net") + link("other.org")), (10, "http://good.com/2", link("mixed.org")),
    ]
    assert {k: v[3] for k, v in verdicts(spark, rows, rules).items()} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "block", 9: "allow", 10: "allow"}


def test_propagation_equals_a_matrix_product(spark):
    import numpy as np

    hosts, edges = ["a", "b", "c", "d"], [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "c", 1)]
    step = np.zeros((4, 4))
    for s, d, n in edges:
        step[hosts.index(s), hosts.index(d)] += n / sum(x[2] for x in edges if x[0] == s)
    start = np.array([4.0, 0, 0, 0])
    now = start
    for _ in range(10):
        now = 0.15 * start + 0.85 * now @ step
    found = propagated(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("a", "trust", 4.0)], "host string, kind string, mass double")).collect()
    assert {r["host"]: round(r["mass"], 9) for r in found} == {h: round(x, 9) for h, x in zip(hosts, now, strict=True) if x}


def test_converged_masses_equal_a_solved_system(spark):
    import numpy as np

    hosts, edges = ["a", "b", *(f"h{k}" for k in range(12))], [("a", "b", 1), ("b", "a", 1), *((f"h{k + 1}", f"h{k}", 1) for k in range(11))]
    step = np.zeros((14, 14))
    for s, d, _ in edges:
        step[hosts.index(s), hosts.index(d)] = 1
    seeds = spark.createDataFrame([("a", "trust", 1.0), ("h0", "distrust", 3.0)], "host string, kind string, mass double")
    found = {(r["host"], r["kind"]): r["mass"] for r in propagated(spark.createDataFrame(edges, "src string, dst string, n long"), seeds, steps=None).collect()}
    expected = {}
    for kind, ways, start in (("trust", step, np.eye(14)[0]), ("distrust", step.T, 3 * np.eye(14)[2])):
        expected |= {(h, kind): x for h, x in zip(hosts, np.linalg.solve(np.eye(14) - 0.85 * ways.T, 0.15 * start), strict=True) if x > 1e-15}
    assert found.keys() == expected.keys() and all(abs(found[k] - x) <= 1e-9 * x for k, x in expected.items())
    assert round(found["a", "trust"], 2) == 0.54 and ("h11", "distrust") in found


def test_large_side_does_not_outvote(spark):
    rules = [Rule("good.com", "/", "allow"), Rule("bad.net", "/x/", "block")]
    link = "<a href='http://{}/'>x</a>".format
    rows = [(k, f"http://good.com/{k}", link("mixed.org") + link("fine.org")) for k in range(200)] + [(1000, "http://bad.net/x/1", ""), (1001, "http://mixed.org/", link("bad.net")), (1002, "http://fine.org/", "")]
    found = {k: v[3] for k, v in verdicts(spark, rows, rules).items()}
    assert found[1001] == "block" and found[1002] == "allow"


def test_hubs_are_dealt_out(spark, monkeypatch):
    from sentryspark.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    edges = [("hub", f"h{k}", k + 1) for k in range(30)] + [(f"h{k}", "end", 1) for k in range(30)]
    found = propagated(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("hub", "trust", 1.0)], "host string, kind string, mass double"), steps=2).collect()
    mass = {r["host"]: r["mass"] for r in found}
    assert abs(mass["end"] - 0.85**2) < 1e-9 and all(abs(mass[f"h{k}"] - 0.85 * 0.15 * (k + 1) / 465) < 1e-9 for k in range(30))


def test_distrust_goes_down_a_long_chain(spark):
    n = 150
    rows = [(0, "http://bad.net/x/1", ""), (1, "http://h1.org/", "<a href='http://bad.net/'>"), *((k, f"http://h{k}.org/", f"<a href='http://h{k - 1}.org/'>") for k in range(2, n)), (n, "http://other.org/", "")]
    found = verdicts(spark, rows, [Rule("bad.net", "/x/", "block")])
    assert [found[k][3] for k in range(n + 1)] == ["block"] * n + ["allow"]


def test_empty(spark):
    assert verdicts(spark, []) == {}



def test_only_the_last_step_is_left(spark):
    before = len(list(_masses(spark)))
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "c", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", "trust", 1.0)], "host string, kind string, mass double")
    assert propagated(edges, seeds, steps=None).count() == 3
    assert len(list(_masses(spark))) == before + 1


def _masses(spark):
    from pathlib import Path

    return Path(spark.conf.get("spark.checkpoint.dir")).glob("url-mass-*")
