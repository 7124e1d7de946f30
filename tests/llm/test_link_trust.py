import random
import re
from collections import Counter, defaultdict

from tracekit.llm import link_trust

SCHEMA = "page_id long, url string, html string, rule string"


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host):])[0]


def rule_of(host, path):
    fit = [r for r in link_trust.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fit, key=lambda r: len(r[1] + r[2]), default=None)


def brute(rows):
    cuts = {i: cut(u) for i, u, _ in rows}
    pages = Counter(cut(u)[0] for _, u, _ in rows if cut(u)[0])
    edges = Counter()
    for _, u, html in rows:
        own = cut(u)[0]
        if own and html is not None:
            for name in {re.sub("[A-Z]", lambda m: m[0].lower(), m) for m in re.findall(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", html)}:
                edges[own, name] += 1
    for h, n in pages.items():
        labels = h.split(".")
        for i in range(1, len(labels)):
            edges[h, ".".join(labels[i:])] += n
    edges = {e: n for e, n in edges.items() if e[1] in pages and e[0] != e[1]}
    seeds = {"allow": Counter(), "block": Counter()}
    for _, u, _ in rows:
        h, p = cut(u)
        if h and (r := rule_of(h, p)):
            seeds[r[0]][h] += 1
    ranks = {}
    for kind, s in seeds.items():
        out = defaultdict(list)
        for (a, b), n in edges.items():
            a, b = (a, b) if kind == "allow" else (b, a)
            out[a].append((b, n))
        start = {h: n / s.total() for h, n in s.items()}
        r = dict(start)
        for _ in range(link_trust.ROUNDS):
            new = {h: v * (1 - link_trust.DAMPING) for h, v in start.items()}
            for h, v in r.items():
                to = out.get(h) or [(h, 1)]
                for b, n in to:
                    new[b] = new.get(b, 0) + link_trust.DAMPING * v * n / sum(x for _, x in to)
            r = new
        ranks[kind] = r
    result = {}
    for i, (h, p) in cuts.items():
        r = rule_of(h, p)
        trust, distrust = (round(ranks[k].get(h, 0.0), 9) for k in ("allow", "block"))
        result[i] = (h, p, r and r[1] + r[2], r[0] if r else "block" if distrust > trust else "allow", trust, distrust)
    return result


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = link_trust.judge_urls(df).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict, round(r.trust, 9), round(r.distrust, 9)) == want[r.page_id]
    return want


def test_against_brute_force(spark):
    rng = random.Random(9)
    hosts = ["Example.com", "www.example.com", "a.www.example.com", "b.example.com", "x.net", "net", "com", "shop.x.net", "q.org", "www.q.org", "farm.org", "z.org", "lone.io"]
    paths = ["/en/1", "/fr/2", "/es/", "", "/", "/en", "?x=/en/", "#/fr/", "/fr/a?b#c"]
    rows = []
    for i in range(300):
        host = rng.choice(hosts)
        links = " ".join(f'<a href="http://{rng.choice(hosts)}/p">' for _ in range(rng.randrange(4)))
        if host == "farm.org":
            links += " shop.x.net"
        rows.append((i, f"http://{host}{rng.choice(paths)}", rng.choice([links, links, None, ""])))
    rows += [(900, None, "q.org"), (901, "no scheme", "q.org"), (902, "http://", ""), (903, "x://y://z/en/", ""), (904, "http://ÀB.com/\nen", ""), (905, "://com/", ""), rows[0]]
    want = check(spark, rows)
    assert {w[3] for w in want.values() if w[2] is None} == {"allow", "block"}


def test_whole_small_table(spark):
    check(spark, [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()])


def test_empty(spark):
    assert link_trust.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, None, None), (2, "http://q.org/", None)])


def test_hosts_that_a_text_names(spark):
    rng = random.Random(8)
    texts = ["see www.example.org. next", "WWW.Example.org.", "ab.cd.9x. q", "ab.cd9", "foo.bar.123", "a.b", "x.y.z9.", "-.ab", "a..bc.de", "1.2.3.4", "no host", "", "http://a.b.co.uk/x.html?y=z.com",
             "a." * 200_000 + "com", "a" * 300_000 + ".com", "9" + "a" * 300_000 + ".9b"]
    texts += ["".join(rng.choices("ab9-. /", k=30)) for _ in range(3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", link_trust.named_hosts("t").alias("n")).collect()
    for r in got:
        t = texts[r.i]
        want = {m.lower() for m in re.findall(r"(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}", t)} if len(t) < 1000 else {13: {t}, 14: {t}, 15: set()}[r.i]
        assert set(r.n) == want, t[:80]
