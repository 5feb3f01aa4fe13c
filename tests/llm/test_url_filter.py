import math
import re
from collections import Counter

from pyspark.sql import functions as F

from recordloom.llm.url_filter import RULES, SEED_WORDS, UrlFilter, host_and_path, url_verdicts, viterbi

PAGES = "page_id bigint, url string, html string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    return ["0" if r[0].isdigit() else r for r in re.findall(r"[^\W\d_]+|[0-9]+", text.lower())]


def parse(url):
    _, scheme, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host):]).group()


def rule_of(host, path, rules=RULES):
    fit = [(len(rule), verdict, rule) for verdict, rule in rules for own, start in [(rule.split("/", 1)[0], "/" + rule.split("/", 1)[1])]
           if (host == own or host.endswith("." + own)) and path.startswith(start)]
    return max(fit)[1:] if fit else (None, None)


def expected(pages, how):
    """The same model in plain Python, with words instead of buckets."""
    parsed = [(page, *parse(url)) for page, url, _ in pages]
    unigrams = Counter()
    for (_, _, html), (_, _, path) in zip(pages, parsed):
        unigrams.update(w for w in re.split(r"[\W\d_]+", re.sub(r"<[^>]*>", " ", html or "").lower()) if 0 < len(w) <= how.longest)
        unigrams.update(w for w in runs(path) if w != "0" and len(w) <= how.longest)
    hosts = {host for _, host, _ in parsed}
    for host in hosts:
        unigrams.update(w for label in host.split(".") if "-" in label for w in runs(label) if w != "0" and len(w) <= how.longest)
    total = max(sum(unigrams.values()), 1_000)
    known = {w: float(n) for w, n in unigrams.items()}
    known |= {s: max(known.get(s, 0.0), total * how.seed_share) for s in how.seeds}

    def split(host):
        return [w for r in runs(host) for w in ([r] if r == "0" or len(r) > 63 else viterbi(r, known, total, how.longest))]

    own = {host: split(host) for host in hosts}
    counts, urls = [Counter(), Counter()], [0, 0]
    for _, host, path in parsed:
        seeded = bool(set(own[host]) & set(how.seeds))
        counts[seeded].update(own[host] + runs(path))
        urls[seeded] += 1
    whole = counts[0] + counts[1]
    sums = [sum(c.values()) for c in (*counts, whole)]

    def weight(w):
        given = how.smoothing * whole[w] / sums[2]
        return math.log((counts[1][w] + given) / (sums[1] + how.smoothing)) - math.log((counts[0][w] + given) / (sums[0] + how.smoothing))

    out = {}
    for page, host, path in parsed:
        odds = math.log((urls[1] + 1) / (urls[0] + 1))
        odds += sum(map(weight, own[host] + runs(path)))
        verdict, rule = rule_of(host, path, how.rules)
        out[page] = (host, path, rule, verdict or ("block" if odds > 0 else "allow"), round(odds, 6))
    return out


def check(frame, how=UrlFilter()):
    pages = [tuple(r) for r in frame.select("page_id", "url", "html").collect()]
    got = url_verdicts(frame, how).collect()
    assert len(got) == len(pages)
    want = expected(pages, how)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict, round(r.log_odds, 6)) for r in got} == want
    return want


def test_given_pages_equal_plain_python(spark):
    found = check(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    # Hosts of advertising and the like carry a hyphen in these tables; where no rule speaks the method finds just them.
    for host, _, rule, verdict, odds in found.values():
        assert (odds > 0) == ("-" in host)
    assert {v[2] for v in found.values()} >= {None, "com/", "net/fr/"}


def test_rules(spark):
    urls = ["http://COM/", "http://com", "http://a.com/x", "http://acom/", "http://example.com/en/1", "http://example.com/en",
            "http://www.example.com/en/x", "http://m.www.example.com/en/", "ftp://x.net/es/?q", "x://net/fr/#f", "http://x.net/ES/",
            "http://x.net/de/", "http://com:80/", "http://u@x.com/p", "://.com/", "http://ÄCOM.com/Ä?a/b", "http://a.net?/es/"]
    check(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES))


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "http:///p", "http://" + "a" * 5_000 + ".org/" + "b" * 100_000, "http://x.org/\n/y",
            "http://" + ".".join("ab" * 500) + ".org", "http://é-x.org/ß/１２", "http://a b.org/c d"]
    rows = [(i, u, None if i % 2 else "<p>a <b>word</b> here < and there") for i, u in enumerate(urls)] + [(None, "http://x.org/", ""), (2, "no scheme", None)]
    frame = spark.createDataFrame(rows, PAGES)
    clash = frame.select("*", *[F.lit("clash").alias(c) for c in ("host", "path", "words", "word", "run", "seeded", "rule", "_n", "log_odds")])
    got = url_verdicts(clash).collect()
    assert len(got) == len(rows)
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    assert [(r[0], r[1]) for r in frame.select(host, path).collect()] == [parse(r[1]) for r in rows]
    assert {r.verdict for r in got} == {"allow"}
    assert url_verdicts(frame.where("false")).collect() == []


def test_segments_and_words_that_go_with_seeds(spark):
    """No seed is in the last hosts: words seen beside seeds block, others don't."""
    known = {"free": 50.0, "casino": 10.0, "win": 40.0, "garden": 60.0, "in": 500.0, "den": 2.0}
    assert viterbi("freecasinowin", known, 5_000.0, 24) == ["free", "casino", "win"]
    assert viterbi("gardenin", known, 5_000.0, 24) == ["garden", "in"] and viterbi("", known, 5_000.0, 24) == []
    assert viterbi("zzz", known, 5_000.0, 24) == ["zzz"]
    text = "<p>free garden win tools plants jackpot book shop of the town and a garden free of tools</p>" * 20
    hosts = ["freecasinowin", "jackpotcasino", "winjackpotpoker", "casinojackpot"] * 5 + ["gardentools", "bookshop", "plantshop", "towngarden"] * 10
    hosts += ["winjackpot", "freejackpotwin", "toolshop", "townbook"]
    frame = spark.createDataFrame([(i, f"http://{h}.org/p/{i}", text) for i, h in enumerate(hosts)], PAGES)
    found = check(frame)
    assert [found[i][3] for i in range(len(hosts) - 4, len(hosts))] == ["block", "block", "allow", "allow"]
    assert not set(SEED_WORDS) & {"jackpot", "win", "free"}
