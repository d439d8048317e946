import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tastegrid.operators import pages
from tastegrid.sources import http

PAGE = """<html><head><style>p {}</style><script>var x = "</p><h2>Notes</h2>";</script></head><body>
<span class="x review-template-rating"> 94 </span><p class="review-roaster">Onyx &amp; Co<p>next<h1 class="review-title">Espresso</h1>
<table><tr><td>Agtron:</td><td> 58/77 </td></tr><tr><td>a<td>b<td>c</tr><tr><td>Est. Price:<td>$15</table>
<h2>Blind Assessment</h2><div><p> Sweet. </p></div><h2>Notes</h2><p>One
 line.</p> loose <p>Two.</p><h2>Bottom Line</h2><p>Good.</p></body>"""


def test_record():
    record = pages.review_record(PAGE)
    assert record == {
        "rating": "94", "roaster": "Onyx & Co", "title": "Espresso", "blind_assessment": "Sweet.", "notes": "One line.Two.", "bottom_line": "Good.",
        "extras": {"agtron": "58/77", "est. price": "$15"},
    }


def test_variants():
    assert pages.review_record("") == dict.fromkeys(pages.FIELDS) | {"extras": {}}
    assert pages.review_record("<table><tr><td>Notes:</td><td>table</td></tr></table><h2>Notes</h2><p>x</p>")["notes"] == "table"
    nested = "<table><tr><td><table><tr><td>k</td><td>v</td></tr></table></td></tr></table>"
    assert pages.review_record(nested)["extras"] == {"k": "v"}
    assert pages.review_record("<h2>Blind <b>Assessment</b></h2><p>x</p>")["blind_assessment"] is None
    assert pages.review_record("<b><p>open<h2>Bottom Line</h2>" + "<i>" * 200 + "<p>deep")["bottom_line"] == "deep"


def test_links_and_crawl(spark):
    base = "https://a.b/review/"
    html = '<a href="/review/page/2/">2</a><a href="/review/some-coffee/">c</a><a href="/review/page">p</a><a href="https://a.b/review/">self</a><a href="/about/">n</a><a>none</a>'
    rows = [(base, html), (base + "page/2/", '<a href="/review/page/3/">3</a><a href="/review/">b</a><a href="/review/two/">t</a>'), (base + "page/3/", None), (base + "page/9/", '<a href="/review/lost/">l</a>')]
    df = spark.createDataFrame(rows, "url string, html string")
    links = {(r.from_url[-6:], r.to_url, r.kind) for r in pages.listing_links(df, base).collect()}
    assert links == {
        ("eview/", base + "page/2/", "listing"), ("eview/", base + "some-coffee/", "review"), ("age/2/", base + "page/3/", "listing"),
        ("age/2/", base + "two/", "review"), ("age/9/", base + "lost/", "review"),
    }
    assert {r.review_url for r in pages.crawl(df, base).collect()} == {base + "some-coffee/", base + "two/"}
    assert pages.review_records(df.limit(0)).count() == 0 and pages.review_records(df).count() == 3


@pytest.mark.parametrize(("attempt", "asked", "pause"), [(0, None, 1.0), (3, None, 8.0), (9, None, 30.0), (2, "120", 120.0), (1, "Wed, 21 Oct", 2.0)])
def test_pauses(attempt, asked, pause):
    assert http.pause_before(attempt, asked, jitter=lambda: 0.0) == pause
    assert pause <= http.pause_before(attempt, asked) <= pause + 1


def test_http_source(spark):
    tries = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            tries[self.path] = tries.get(self.path, 0) + 1
            code = {"/gone": 404, "/busy": 503 if tries[self.path] < 2 else 200, "/down": 500}.get(self.path.split("?")[0], 200)
            self.send_response(code)
            if code != 200:
                self.send_header("Retry-After", "0")
            self.end_headers()
            rates = b'{"rates": {"EUR": 0.9}}'
            self.wfile.write(rates if "rates" in self.path else f"page {self.path}".encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(http.HttpPages)
    urls = "\n".join(f"{at}/{p}" for p in ("ok", "gone", "busy", "down"))
    got = spark.read.format("http_pages").option("urls", urls).option("at_once", 2).option("attempts", 3).load()
    assert {(r.url.rsplit("/")[-1], r.html) for r in got.collect()} == {("ok", "page /ok"), ("gone", None), ("busy", "page /busy"), ("down", None)}
    assert tries == {"/ok": 1, "/gone": 1, "/busy": 2, "/down": 3}
    rates = http.read_rates(spark, at + "/rates-{day}", ["2024-01-01"]).union(http.read_rates(spark, at + "/down?{day}", ["2024-02-01"], attempts=1))
    assert sorted((str(r.review_date), r.price_currency, r.rate) for r in rates.collect()) == [("2024-01-01", "EUR", 0.9), ("2024-02-01", None, None)]
    server.shutdown()


def test_files(spark, tmp_path):
    from tastegrid.sources import files, settings

    df = spark.createDataFrame([("a\nb, \"q\"", None, "NR"), (None, "NA", "na")], "x string, y string, z string")
    files.write_csv(df, str(tmp_path / "c.csv"), one_file=True)
    assert {tuple(r) for r in files.read_records(spark, str(tmp_path / "c.csv")).collect()} == {('a\nb, "q"', None, "NR"), (None, None, "na")}
    with pytest.raises(ValueError, match="no reader"):
        files.read_records(spark, "x.xls")
    with pytest.raises(FileNotFoundError):
        files.read_records(spark, str(tmp_path / "none.json"))
    with pytest.raises(FileNotFoundError, match="price index"):
        files.read_cpi(spark, str(tmp_path / "none.csv"))
    (tmp_path / "cpi.csv").write_text("Year,Jan,Feb,HALF1,HALF2\n2024,300.5,,1,2\n")
    assert sorted((r.cpi or 0) for r in files.read_cpi(spark, str(tmp_path / "cpi.csv")).collect()) == [0, 300.5]
    (tmp_path / "r.json").write_text('{"2024-01-01": {"EUR": 0.9, "USD": 1.0}, "2024-02-01": {}}')
    rates = files.read_rates(spark, str(tmp_path / "r.json"))
    assert rates.count() == 3 and rates.where("rate is null").count() == 1
    files.write_rates(rates, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"2024-01-01":{"EUR":0.9,"USD":1.0}}', '{"2024-02-01":{}}']
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2, "m": "x"}]')
    assert files.read_records(spark, str(tmp_path / "a.json")).count() == 2
    assert files.write_unless_empty(df.limit(0), str(tmp_path / "no")) is False and files.write_unless_empty(df, str(tmp_path / "yes")) is True
    assert files.dated_name("reviews", ".csv").endswith("_reviews.csv") and files.csv_path_for("/a/b.json", "/c") == "/c/b.csv"
    (tmp_path / "pyproject.toml").touch()
    (tmp_path / "deep" / "er").mkdir(parents=True)
    assert settings.project_root(tmp_path / "deep" / "er") == tmp_path and settings.Folders(tmp_path).raw.name == "raw"
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where(F.col("z") == "na").count() == 1
