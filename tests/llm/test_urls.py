import random

import duckdb

from vexel.llm import urls
from vexel.llm.queries import op7_urls

SCHEMA = "page_id long, url string, html string, host string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, (u, h) in enumerate(rows)], SCHEMA)


def test_rules_and_parsing(spark):
    rows = ["http://A.Example.com/en/x?q#f", "https://www.example.com/en/1", "http://x.net/fr/", "http://x.net/fr", "http://x.net?x=/fr/", "http://xcom/", "noscheme.com/en/", None, "http://com/", "ftp://É.NET/es/ñ", "http://", "http://example.com/en/", "http://x.org/a://b/c"]
    out = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages(spark, [(u, None) for u in rows])).collect()}
    assert out[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert out[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert out[2] == ("x.net", "/fr/", "net/fr/", "block")
    assert out[3] == ("x.net", "/fr", None, "allow") and out[4] == ("x.net", "", None, "allow")
    assert out[5] == ("xcom", "/", None, "allow")
    assert out[6] == ("", "", None, "allow") == out[7] == out[10]
    assert out[8] == ("com", "/", "com/", "allow")
    assert out[9] == ("É.net", "/es/ñ", "net/es/", "block")
    assert out[11][3] == "block" and out[12][:2] == ("x.org", "/a://b/c")


def test_blocks_pass_to_aliases_but_not_past_an_allow(spark):
    canonical = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    refresh = lambda u: f'<META HTTP-EQUIV="refresh" content="0; url={u}">'
    rows = [
        ("http://a.org/1", canonical("http://b.org/2")),
        ("http://b.org/2", refresh("http://bad.net/fr/3")),
        ("http://bad.net/fr/3", None),
        ("http://b.org/2#frag", None),
        ("http://c.org/1", canonical("http://bad.net/es/9")),  # the target is no page itself
        ("http://d.org/1", canonical("http://bad.net/fr/d")),
        ("http://good.com/d", canonical("http://d.org/1")),  # an explicit allow in the component
        ("http://e.org/x", canonical("/y")),
        ("http://e.org/y", None),
    ]
    got = {r.id: r.verdict for r in urls.judge(pages(spark, rows)).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow"}
    more = spark.createDataFrame([("http://e.org/y", "http://z.net/fr/")], "from_url string, to_url string")
    got = {r.id: r.verdict for r in urls.judge(pages(spark, rows), redirects=more).collect()}
    assert got[7] == got[8] == "block"


def test_empty(spark):
    assert urls.judge(pages(spark, [])).count() == 0


def test_links_relative_to_the_page_entities_and_all_tags(spark):
    canonical = lambda u: f'<link rel="canonical" href="{u}">'
    refresh = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    base = "http://a.net/fr/d/p"
    rows = [(base, refresh("next.html") + refresh("?id=2&amp;x=1") + canonical("../x") + canonical("./y/../z") + canonical("//b.org/h") + canonical("/r?u=http://c.org/"))]
    want = ["http://a.net/fr/d/next.html", "http://a.net/fr/d/p?id=2&x=1", "http://a.net/fr/x", "http://a.net/fr/d/z", "http://b.org/h", "http://a.net/r?u=http://c.org/"]
    assert {(r.a, r.b) for r in urls.page_links(pages(spark, rows)).collect()} == {(base, w) for w in want}
    rows += [("http://b.org/h", None), ("http://a.net/r?u=http://c.org/", None), ("http://other.org/", canonical("mailto:x@y") + canonical("http://[bad/"))]
    assert [r.verdict for r in urls.judge(pages(spark, rows)).orderBy("id").collect()] == ["block", "block", "block", "allow"]


def site(r, n, hosts):
    """Pages of a few hosts that link each other in every form: chains, hubs, cycles and links to pages that are none."""
    own = [f"http{r.choice(['', 's'])}://{r.choice(hosts)}/{r.choice(['en/', 'fr/', 'es/', 'a/b/', ''])}{i}" for i in range(n)]
    path = lambda u: "/" + u.split("/", 3)[3]
    rows = []
    for i, u in enumerate(own):
        tags = []
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            to = r.choice([own[max(0, i - 1)], own[min(i // 50 * 50, n - 1)], r.choice(own), f"http://gone{r.randrange(9)}.net/fr/x"])
            if to.split("/")[:3] == u.split("/")[:3]:
                to = r.choice([to, path(to), "//" + to.split("//")[1], "../" * (path(u).count("/") - 1) + path(to)[1:], "./x/../" + path(to).rsplit("/", 1)[1]])
            to = r.choice([to, to, to + "?a=1&amp;b=2", "?p=3", "x.html", "#top", "mailto:a@b.net"])
            q = r.choice(['"', "'", ""])
            tags.append(r.choice([f"<link rel=canonical href={q}{to}{q}>", f"<LINK href={q}{to}{q} REL='canonical'>", f'<link rel="canonical"\nhref={q}{to}{q} />', f"<meta http-equiv=refresh content=0;url={q}{to}{q}>"]))
        rows.append((u.replace("http", r.choice(["http", "HTTP"])) + r.choice(["", "#f"]), "".join(tags) if i % 7 else None))
    return rows


def test_matches_union_find_over_thousands_of_edges(spark, tmp_path):
    r = random.Random(77)
    rows = site(r, 3000, ["a.org", "b.org", "c.net", "d.example.com", "e.com", "www.example.com"]) + [(None, "<link rel=canonical href=/x>"), ("no url", None)] + [("http://hub.org/", None)]
    more = [("http://hub.org/", f"http://spoke{i}.org/") for i in range(3000)] + [(f"http://chain{i}.org/", f"http://chain{i + 1}.org/") for i in range(400)] + [("http://chain400.org/", "http://bad.net/es/"), ("http://spoke7.org/", "http://x.net/fr/"), (None, "http://z.net/")]
    rows += [("http://chain0.org/", None), ("http://spoke8.org/#x", None)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    def node(u):
        if u is None or "://" not in u:
            return None
        scheme, rest = u.split("#")[0].split("://", 1)
        host = rest.split("/")[0].split("?")[0]
        return f"{scheme.lower()}://{host.lower()}{rest[len(host):]}"

    def own(u):
        best = None
        rest = u.split("://", 1)[1]
        host = rest.split("/")[0].split("?")[0]
        path = rest[len(host):].split("?")[0]
        for x in urls.RULES:
            if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path) and (best is None or len(x.host + x.path) > len(best.host + best.path)):
                best = x
        return best.verdict if best else None

    links = [(u, t) for u, h in rows if u and h for t in urls.declared(u, h)] + more
    links = [(node(a), node(b)) for a, b in links]
    links = [(a, b) for a, b in links if a and b]
    assert len(links) > 5000
    for a, b in links:
        up[root(a)] = root(b)
    told = {}
    for x in list(up):
        told.setdefault(root(x), set()).add(own(x))
    want = {}
    for i, (u, _) in enumerate(rows):
        n = node(u)
        mine = told.get(root(n), set()) if n in up else set()
        want[i] = (own(n) if n else None) or ("block" if "block" in mine and "allow" not in mine else "allow")
    got = {x.id: x.verdict for x in urls.judge(pages(spark, rows), redirects=spark.createDataFrame(more, "from_url string, to_url string")).collect()}
    assert got == want
    plain = {i: (own(node(u)) if node(u) else None) or "allow" for i, (u, _) in enumerate(rows)}
    assert sum(plain[i] != want[i] for i in want) > 20


def test_query_equals_its_sql_with_all_forms_of_links(spark, tmp_path):
    rows = site(random.Random(5), 400, ["a.org", "b.org", "c.net", "d.example.com", "e.com"]) + [(None, None), ("", "<link rel=canonical href=/x>"), ("http://a.org/en/0", None)]
    pages(spark, rows).select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(db.sql(urls.SQL).project("page_id, host, path, rule, verdict").fetchall(), key=str)
    got = sorted((tuple(x) for x in op7_urls(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == want and sum(x[3] is None and x[4] == "block" for x in got) > 5
