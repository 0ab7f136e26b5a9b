import random
import re

from tyscope.llm import url_rules as U


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):], re.S)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judge(url, rules):
    host, path = split(url)
    fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_against_brute_force(spark):
    rnd = random.Random(6)
    label = lambda: rnd.choice(["a", "b", "com", "é", "x-1"])
    path = lambda: "".join(rnd.choice(["/", "en/", "a", "/é", "b"]) for _ in range(rnd.randrange(5)))
    rules = list({(h, p): (rnd.choice(["allow", "block"]), h, p) for h, p in (
        (".".join(label() for _ in range(rnd.randrange(1, 4))), "/" + path()) for _ in range(120))}.values())
    urls = [rnd.choice(["http://", "HTTPS://", "//", ""]) + ".".join(label() for _ in range(rnd.randrange(5))) + rnd.choice(["/", "", "?q=/", "#"])
            + path() + rnd.choice(["", "?x=://y", "#z"]) for _ in range(900)]
    urls += [None, "", "://", "http://COM/En/", "x://a://b/c", "http://a.com\n/en/", "http://" + "a." * 200 + "com/" + "b/" * 5000] + ["http://com/a"] * 400
    pages = spark.createDataFrame([(i if i % 50 else None, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    table = U.rule_table(spark, rules)
    got = U.judge_urls(pages.withColumn("rule", U.F.lit(1)).repartition(4), table, partitions=7).collect()
    want = [(i if i % 50 else None, *judge(u, rules)) for i, u in enumerate(urls)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_stack_holds_the_rules_around(spark):
    rules = [("allow", "com", "/"), ("block", "com", "/a/"), ("allow", "com", "/a/b"), ("block", "b.com", "/a/")]
    stacks = {r.key: [x.rule for x in r.stack] for r in U.stacked_rules(U.rule_table(spark, rules)).collect()}
    assert stacks["com/a/b"] == ["com/", "com/a/", "com/a/b"] and stacks["com.b/a/"] == ["b.com/a/"]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    rules = U.rule_table(spark, [("block", "a.com", "/")])
    assert [r.verdict for r in U.judge_urls(pages, rules.limit(0)).collect()] == ["allow"]
    assert U.judge_urls(pages.limit(0), rules).count() == 0
