"""Readers over landed files and scope validation."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cairnflow.sources import github, hackernews, records, reddit, scopes, stackexchange, worklists


def story(i, **changes):
    return {"id": i, "type": "story", "by": "ann", "time": 1_700_000_000 + i, "title": f"t{i}", "text": "x", "url": "u", "score": 3} | changes


def test_hackernews_folder_in_feed_order(spark, tmp_path):
    (tmp_path / "items").mkdir()
    (tmp_path / "feeds").mkdir()
    items = [story(1), story(2, deleted=True), story(3), story(4, text=None), story(5, type="job"), story(6, dead=True)]
    (tmp_path / "items" / "a.json").write_text("\n".join(json.dumps(i) for i in items))
    (tmp_path / "feeds" / "topstories.json").write_text("[3, 2, true, 1.5, 1]")
    (tmp_path / "feeds" / "newstories.json").write_text("[1, 6, 4, 5]")
    (tmp_path / "feeds" / "beststories.json").write_text('{"no": "list"}')
    got = {r.external_id: r for r in hackernews.read(spark, str(tmp_path)).collect()}
    assert set(got) == {"3", "1", "6"}
    assert [r.external_id for r in hackernews.read(spark, str(tmp_path), limit=2).collect()] == ["3", "1"]
    assert json.loads(got["3"].raw_payload) == items[2]


def test_all_rows_unless_a_limit_is_given(spark, tmp_path):
    (tmp_path / "items").mkdir()
    (tmp_path / "feeds").mkdir()
    (tmp_path / "items" / "a.json").write_text("\n".join(json.dumps(story(i)) for i in range(600)))
    (tmp_path / "feeds" / "topstories.json").write_text(json.dumps(list(range(600))))
    assert hackernews.read(spark, str(tmp_path)).count() == 600
    assert hackernews.read(spark, str(tmp_path), limit=500).count() == 500


def test_values_out_of_range_do_not_stop_the_job(spark):
    rows = [story(1, score=3_000_000_000), story(2, time=1_700_000_000_000_000), story(3)]
    payloads = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    got = {r.external_id: r.engagement_score for r in hackernews.normalize(payloads).collect()}
    assert got == {"1": None, "3": 3}


def test_github_stops_at_a_short_page_and_drops_repeats(spark):
    issue = lambda n: json.dumps({"number": n, "title": "t", "html_url": "h", "created_at": "2024-01-01T00:00:00Z"})
    rows = [("o/a", 1, 0, issue(1)), ("o/a", 1, 1, issue(2)), ("o/a", 2, 0, issue(2)), ("o/a", 3, 0, issue(9)), ("o/b", 1, 0, issue(1))]
    pages = spark.createDataFrame(rows, "repository string, page int, position int, value string")
    got = github.scan_repositories(pages, ["o/b", "o/a"], 10, page_size=2).collect()
    assert [r.external_id for r in got] == ["o/b#1", "o/a#1", "o/a#2"]
    assert [r.external_id for r in github.scan_repositories(pages, ["o/a"], 1, page_size=2).collect()] == ["o/a#1"]


def test_reddit_listings(spark, tmp_path):
    post = lambda i, **c: {"data": {"id": f"p{i}", "title": "t", "selftext": "b", "url": "u", "author": "a", "created_utc": 1.5, "score": 1} | c}
    children = [post(1), post(2, author="[deleted]"), post(3, url="", permalink="/r/x"), {"data": 7}, post(4, created_utc=True)]
    (tmp_path / "django.json").write_text(json.dumps({"data": {"children": children}}))
    got = reddit.read(spark, str(tmp_path), ["r/django"]).collect()
    assert [(r.external_id, r.url) for r in got] == [("p1", "u"), ("p3", "https://www.reddit.com/r/x")]
    assert got[0].published_at.microsecond == 500000


@pytest.mark.parametrize(
    "call",
    [
        lambda: scopes.feeds([]),
        lambda: scopes.feeds(["topstories", "TOPSTORIES"]),
        lambda: scopes.feeds(["jobs"]),
        lambda: scopes.repositories(["one"]),
        lambda: scopes.repositories(["a/b", "A/B/"]),
        lambda: scopes.subreddits([" "]),
        lambda: scopes.sources(["stackoverflow"]),
        lambda: scopes.positive_limit(0),
    ],
)
def test_bad_scopes(call):
    with pytest.raises(ValueError):
        call()


def test_scope_spelling():
    assert scopes.feeds([" TopStories "]) == ("topstories",)
    assert scopes.repositories(["Owner/Repo/"]) == ("owner/repo",)
    assert scopes.subreddits(["r/django", " flask "]) == ("django", "flask")
    assert scopes.subreddits(["r/django", "", "r/django"]) == ("django", "django")
    with pytest.raises(TypeError):
        scopes.feeds("topstories")
    with pytest.raises(TypeError):
        scopes.positive_limit(True)


def line(**changes):
    return {"source": "s", "external_id": "1", "is_problem": True, "confidence": 0.5, "reason": "r", "classifier_name": "c"} | changes


def test_accepted_fails_on_a_bad_line(spark):
    lines = spark.createDataFrame([(json.dumps(line()),), (json.dumps(line(confidence=2)),)], "value string")
    parsed = records.parse(lines, records.CLASSIFICATION)
    good, bad = records.split(parsed)
    assert good.count() == 1 and bad.head().rejected == "confidence must be between 0 and 1"
    with pytest.raises(Exception, match="invalid record"):
        records.accepted(parsed).collect()


def test_duplicate_kinds(spark):
    rows = [line(), line(), line(external_id="2"), line(external_id="2", reason="other"), line(external_id="3")]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))
    got = {r.external_id: r.kind for r in records.repeated_keys(df, "source", "external_id").collect()}
    assert got == {"1": "identical", "2": "contradictory"}


def test_results_resume(spark, tmp_path):
    work = spark.createDataFrame([("s", str(i), f"text {i}") for i in range(6)], "source string, external_id string, document_text string")
    classify = lambda df: df.select("source", "external_id", F.lit(True).alias("is_problem"), F.lit(1.0).alias("confidence"), F.lit("r").alias("reason"), F.lit("c").alias("classifier_name"))
    out = str(tmp_path / "out")
    worklists.append_results(spark, work.filter("external_id < '3'"), out, classify)
    assert worklists.append_results(spark, work, out, classify).count() == 6


def test_scopes_as_columns(spark):
    names = [" TopStories ", "jobs", None, "Owner/Repo/", "one", "a//b", "a/b/c"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    known = lambda scope: [r[0] for r in df.select(scope.is_known(F.col("name"))).collect()]
    assert known(scopes.FEEDS) == [True] + [False] * 6
    assert known(scopes.REPOSITORIES) == [False, False, False, True, False, False, False]


def test_fences(spark):
    good = '{"is_problem": true, "confidence": 0.5, "reason": "r"}'
    texts = [good, f"```json\n{good}\n```", f"``` {good} ```", f"text ```{good}```", f"```{good}", f"```{good}```x", "", None, f"```{good}``````", good.replace('"r"', '"uses ``` marks"'), "```json\n" + good.replace('"r"', '"uses ``` marks"') + "\n```", good + good, f"[{good}]"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, output string")
    rows = sorted(records.parse_model_output(df, "output", "n").collect(), key=lambda r: r.n)
    assert [r.malformed for r in rows] == [False, False, False] + [True] * 6 + [False, False, True, True]
    assert [r.reason for r in rows][9:11] == ["uses ``` marks"] * 2


def test_stack_exchange_pages(spark, tmp_path):
    def question(n, **change):
        row = {"question_id": n, "title": f"How to &quot;x&quot; {n}?", "link": f"https://q/{n}", "creation_date": 1704067200 + n, "body": "<p>b</p>", "owner": {"display_name": "J&#246;rg"}, "score": n, "tags": ["etl"]}
        return {k: v for k, v in (row | change).items() if v is not ...}

    def land(site, page, items, more):
        folder = tmp_path / site
        folder.mkdir(exist_ok=True)
        (folder / f"page-{page}.json").write_text(json.dumps({"items": items, "has_more": more}))

    bad = [question(4, question_id="4"), question(5, title=" "), question(6, link=None), question(7, creation_date=1.5), question(8, creation_date=...), 3, None]
    land("a", 1, [question(1), question(2, owner={"user_type": "does_not_exist"}, score=None, body=None), *bad], True)
    land("a", 2, [question(1, title="again"), question(3)], False)
    land("a", 3, [question(9)], True)
    land("b", 1, [question(1, owner=...)], True)
    land("b", 3, [question(2)], True)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "page-1.json").write_text("not json")
    rows = {r.external_id: r for r in stackexchange.read(spark, str(tmp_path), [" B", "a", "c"]).collect()}
    assert set(rows) == {"a#1", "a#2", "a#3", "b#1"}
    one, two = rows["a#1"], rows["a#2"]
    assert (one.title, one.author, one.url, one.engagement_score, one.body) == ('How to "x" 1?', "Jörg", "https://q/1", 1, "<p>b</p>")
    assert one.published_at.timestamp() == 1704067201 and json.loads(one.raw_payload)["tags"] == ["etl"]
    assert (two.author, two.engagement_score, two.body, rows["b#1"].author) == (None, None, "", None)
    assert [r.external_id for r in stackexchange.read(spark, str(tmp_path), ["b", "a"], 2).collect()] == ["b#1", "a#1"]
    with pytest.raises(ValueError):
        stackexchange.read(spark, str(tmp_path), ["a", "A "])
