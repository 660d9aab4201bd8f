"""Numbers, rewrites, sources, sinks and streams on small inputs."""

import hashlib
import json
import re
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscope.functions import envelopes, pubno
from folioscope.operators import analytics, claims
from folioscope.plans import rewrites
from folioscope.sources import readers, sinks
from folioscope.streaming import events as streams


def values(spark, column, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("raw"))).collect()]


def test_keys(spark):
    want = {
        "US20230081319A1": "US20230081319A1", "US 2023/0081319 A1": "US20230081319A1", "TWI854998B": "TWI854998", "CN119230141A": "CN119230141",
        "US11213256B2": "US11213256B2", "KR20260067039A": "KR20260067039", "TWM305142U": "TWM305142", "109112770": "TW109112770", "I684433B": "TWI684433", "": "US",
    }
    assert values(spark, pubno.key, list(want)) == list(want.values())
    assert values(spark, pubno.key, [None]) == ["US"]
    assert values(spark, pubno.key_variants, ["CN119230141A", "US11213256B2"]) == [["CN119230141", "CN119230141A"], ["US11213256B2"]]


def test_forms(spark):
    raws = ["US20230053201A1", "US2023053201A1", "US9997041B2", "US09997041B2", "US06150941A", "US11213256B2", "CN121811579", "TW-I684433-B", "?"]
    want = [
        ["US.20230053201.A1", "US.2023053201.A1"], ["US.2023053201.A1", "US.20230053201.A1"], ["US.9997041.B2"], ["US.09997041.B2", "US.9997041.B2"], ["US.06150941.A", "US.6150941.A"],
        ["US.11213256.B2"], ["CN.121811579"], ["TW.I684433.B"], [],
    ]
    assert values(spark, pubno.dotted_variants, raws) == want
    got = values(spark, pubno.web_form, ["TW109112770", "TW202138759A", "US09993161B1", "TWI684433B"])
    assert [tuple(r) for r in got] == [("109112770", "apply"), ("202138759", "pub"), ("09993161", "pub"), ("I684433", "pub")]
    with pytest.raises(ValueError):
        pubno.web_form(F.lit("TW1"), "bogus")
    assert values(spark, pubno.unpadded, ["US09993161B1", "TWI684433B", "???"]) == ["US9993161", "TWI684433", None]
    assert values(spark, pubno.family_key, ["US9993166B1", "US9993166A2", "US9993166"]) == ["US9993166"] * 3
    assert values(spark, pubno.tw_kind, ["TW200644333", "tw 109112770", "TWI684433", "TW578729U", "US11213256B2", "TW12345", "109112770"]) == ["identifier", "apply", "identifier", "identifier", "unknown", "unknown", "unknown"]


def test_cql():
    want = {
        "radar AND fall": "txt=radar and txt=fall", '"millimeter wave" OR radar': 'txt="millimeter wave" or txt=radar', "(radar OR lidar) AND fall": "(txt=radar or txt=lidar) and txt=fall",
        "radar NOT vehicle": "txt=radar not txt=vehicle", "": "", '"vital sign"': 'txt="vital sign"',
    }
    assert {k: rewrites.cql(k) for k in want} == want
    assert rewrites.cql_of("a", cpc="H01L", applicant="A B", since="2020", until="2021") == 'cpc=H01L and txt=a and pa="A B" and pd within "2020 2021"'


def test_shards():
    q = '(a or b or c or "d e") and (x or y) and not z'
    cut = rewrites.shards(q, lambda s: len(s) <= 26)
    assert all(len(s) <= 26 and s.endswith("and not z") for s in cut) and len(cut) > 1
    assert rewrites.shards(q) == [rewrites.render(rewrites.parse(q))]
    with pytest.raises(rewrites.Irreducible):
        rewrites.shards("alpha and beta", lambda s: len(s) < 5)


def test_date_slices(spark):
    df = spark.range(100).select(F.date_add(F.lit(date(2020, 1, 1)), (F.col("id") % 10).cast("int")).alias("day"))
    got = rewrites.date_slices(df, "day", limit=25)
    assert sum(n for *_, n, _ in got) == 100 and not any(cut for *_, cut in got)
    assert got[0][0] == date(2020, 1, 1) and got[-1][1] == date(2020, 1, 10)
    assert rewrites.date_slices(df.where("false"), "day") == []
    assert rewrites.date_slices(df, "day", limit=5, depth=1) == [(date(2020, 1, 1), date(2020, 1, 5), 50, True), (date(2020, 1, 6), date(2020, 1, 10), 50, True)]


def test_union_first(spark):
    a, b = (spark.createDataFrame(x, "k string, v int") for x in ([("x", 1), ("", 2)], [("x", 3), ("y", 4), (None, 5)]))
    assert sorted(map(tuple, rewrites.union_first([a, b], "k").select("v", "shard").collect())) == [(1, 0), (2, 0), (4, 1), (5, 1)]


def test_sources(spark, tmp_path):
    lines = tmp_path / "log.jsonl"
    lines.write_text('{"a": 1}\n\nbad\n[1]\n{"a": 2}\n')
    df, bad = readers.json_lines(spark, str(lines), "a int")
    assert sorted(r.a for r in df.collect()) == [1, 2] and bad == 2
    lines.write_text("bad\n")
    with pytest.raises(readers.BadInput):
        readers.json_lines(spark, str(lines), "a int")
    for i, text in enumerate(('{"records": [{"a": 1}, {"a": 2}]}', '[{"a": 1}, {"a": 2}]')):
        (tmp_path / f"r{i}.json").write_text(text)
        assert sorted(r.a for r in readers.records(spark, str(tmp_path / f"r{i}.json"), "a int").collect()) == [1, 2]
    (tmp_path / "x.json").write_text("nope")
    with pytest.raises(readers.BadInput):
        readers.records(spark, str(tmp_path / "x.json"), "a int")
    (tmp_path / "t.csv").write_bytes("﻿號碼,標題,score\r\nUS1,\"a, b\",9\r\n".encode())
    out = readers.mapped_csv(spark, str(tmp_path / "t.csv"), {"號碼": "pubno", "標題": "title", "score": "score"}, drop=("score",))
    assert out.columns == ["pubno", "title"] and tuple(out.first()) == ("US1", "a, b")
    texts = spark.createDataFrame([('{"a": 1}',), ('{"a": "x\ty"}',), ('{"a": "c:\\dir"}',), ("nope",)], "t string")
    got = [r[0] for r in texts.select(F.try_variant_get(readers.tolerant_json(F.col("t")), "$.a", "string")).collect()]
    assert got == ["1", "x\ty", "c:\\dir", None]


def test_ladder(spark):
    none, some = spark.range(0), spark.range(3)
    df, tried = readers.ladder([("a", {"kw"}, some), ("b", {"kw", "date"}, none), ("c", {"kw", "date"}, some)], {"date"})
    assert [t["outcome"] for t in tried] == ["skipped", "miss", "hit"] and {r.source_level for r in df.collect()} == {"c"}
    assert readers.ladder([("a", set(), none)], set())[0] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", ["a", "b"], None)], "p string, c array<string>, n int")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"), {"p": "P", "c": "C", "n": "N"})
    assert next((tmp_path / "out").glob("*.csv")).read_bytes().replace(b'""', b"") == b"P,C,N\r\nx,a; b,\r\n"
    sinks.append_json(df, str(tmp_path / "log"))
    sinks.append_json(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    files = spark.createDataFrame([("a.csv", 5), ("b.md", 0)], "rel string, size long")
    sinks.preflight(files)
    for f, rule in ((files.where("false"), {}), (files, {"least": 3}), (files, {"not_empty": True}), (files, {"contains": ("c.",)})):
        with pytest.raises(sinks.ExportError):
            sinks.preflight(f, **rule)
    assert sinks.columns_for(["k"], {"p": ["a", "b"]}, "p", {"a", "b", "c"}, ("c", "z"), ("k", "b"), ("ai",)) == ["k", "a", "c", "ai"]


def test_friction(spark):
    df = spark.createDataFrame([(False, "X_1", None), (False, "OK", None), (None, "got 503 there", None), (True, None, "f"), (True, None, None), (False, None, None)], "s boolean, c string, a string")
    got = [r[0] for r in df.select(envelopes.friction(F.col("s"), F.col("c"), F.col("a"), ["OK"])).collect()]
    assert got == ["envelope:X_1", None, "http_error:503", "advisory:f", None, "envelope:unknown"]


def test_claims(spark):
    text = "1. A device (with (a (deep (nest (here))))) such as this.\n2. The device of claim 1, of good size.\n3. As in claim 3."
    parsed = claims.parse(spark.createDataFrame([(1, text), (2, None), (3, "no claims")], "id int, t string"), "id", "t")
    assert [(r.claim, r.depends_on, r.independent) for r in parsed.orderBy("claim").collect()] == [(1, None, True), (2, 1, False), (3, None, False)]
    found = claims.issues(parsed, "id")
    assert sorted((r.claim, r.term) for r in found.collect()) == [(1, "nesting"), (1, "such as"), (2, "good")]
    assert tuple(claims.scores(parsed, found, "id").first()) == (1, 3, 3, round(100 - 11 / 3, 6))


def test_claims_of_numbered_turns(spark, tmp_path):
    """Turns that hold numbered lines are in claims, issues and scores."""
    from folioscope import catalog

    turns = [(1, 0, "u", "A pump."), (1, 1, "a", "Claims:\n1. A good valve.\n2. The valve of claim 1, such as this.\n"), (1, 2, "u", " \t"), (2, 0, "u", "5\n10. A seal"), (3, 0, "u", "plain claim 4"), (3, 1, "u", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = []
    for conv in (1, 2, 3):
        text = "\n".join(f"{t + 1}. {x}" for c, t, _, x in turns if c == conv and x and x.strip(" "))
        for n, body in re.findall(r"(?:^|\n)(\d+)\.\s+(.+?)(?=\n\d+\.|$)", text, re.DOTALL):
            parent = re.search(r"claim (\d+)", body, re.I)
            want.append((conv, int(n), hashlib.md5(body.strip().encode()).hexdigest(), int(parent[1]) if parent and parent[1] != n else None, parent is None))
    got = {name: [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()] for name in ("claim_parse", "claim_rules", "claim_scores")}
    assert sorted(got["claim_parse"], key=str) == sorted(want, key=str) and len(want) > 6
    assert sorted(got["claim_rules"]) == [(1, 1, "subjective_term", "good", "IMPORTANT"), (1, 2, "definiteness", "such as", "IMPORTANT")]
    assert {r[0]: r[2] for r in got["claim_scores"]} == {1: 2, 2: 0, 3: 0}


def test_terms(spark):
    texts = ["Radar 雷達 radar與雷達系統設備 裝 radar中 the", "雷達, LIDAR 雷達系統設備甲 方法", None, "étude 123 abc_d"]
    stop, want = ["the", "方法"], Counter()
    for t in filter(None, texts):
        want.update(w.lower() for w in re.findall(r"\b[a-zA-Z]{3,}\b", t) if w.lower() not in stop)
        want.update(w for w in re.findall(r"[\u4e00-\u9fa5]{2,4}", t) if w not in stop)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["term"]: r["n"] for r in analytics.term_counts(df, "t", stop).collect()}
    assert got == want and want["雷達"] == 2 and want["雷達系統"] == 1
    assert {r["term"] for r in analytics.term_counts(df, "t", stop, cjk=False).collect()} == {"radar", "lidar"}


def anchored(now):
    """Window of a moment on Taipei's clock, stepped back day by day."""
    day = now
    if now.weekday() < 5 and 8 <= now.hour < 18:
        return f"{now:%Y-%m-%d}:narrow"
    if now.weekday() >= 5:
        while day.weekday() != 4:
            day -= timedelta(days=1)
    elif now.hour < 8:
        day -= timedelta(days=1)
    return f"{day:%Y-%m-%d}:wide"


def test_quota_window(spark):
    first = datetime(2023, 12, 28)
    local = [first + timedelta(minutes=30 * k, microseconds=k % 2 * 999_999) for k in range(2 * 24 * 12)] + [datetime(1969, 12, 29, 7, 59, 59, 999_999), datetime(1960, 2, 29, 18)]
    utc = [(i, t - timedelta(hours=8), t) for i, t in enumerate(local)]
    rows = spark.createDataFrame(utc, "i int, u timestamp_ntz, t timestamp_ntz")
    window = analytics.quota_window
    want = [anchored(t) for t in local]
    assert [r[0] for r in rows.orderBy("i").select(window(F.col("t"))).collect()] == want
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            moment = F.timestamp_micros(F.expr("cast(unix_micros(cast(concat(u, ' UTC') as timestamp)) as bigint)"))
            assert [r[0] for r in rows.orderBy("i").select(window(moment)).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    monday = rows.where("t = timestamp_ntz'2024-01-01 07:00:00'").select(window(F.col("t")), window(F.col("t"), monday_fix=True)).first()
    assert tuple(monday) == ("2023-12-31:wide", "2023-12-29:wide")
    assert spark.range(1).select(window(F.lit(None).cast("timestamp"))).first()[0] is None


def test_quota_latch_holds(spark):
    """An account that is exhausted in the evening, or on Saturday, stays so over midnight and frees at the next window."""
    rows = [("a", datetime(2024, 1, 3, 20), True), ("a", datetime(2024, 1, 4, 2), False), ("a", datetime(2024, 1, 4, 9), False), ("b", datetime(2024, 1, 6, 9), True), ("b", datetime(2024, 1, 7, 9), False)]
    events = spark.createDataFrame(rows, "account string, ts timestamp_ntz, exhausted boolean")
    got = streams.latch(events, "account", analytics.quota_window(F.col("ts")), F.col("exhausted"))
    assert sorted(map(tuple, got.collect())) == [("a", "2024-01-03:wide", True), ("a", "2024-01-04:narrow", False), ("b", "2024-01-05:wide", True)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("2024-01-01 00:10:00", 1, "a"), ("2024-01-01 00:20:00", 1, "a"), ("2024-01-01 01:10:00", 2, "a"), ("2024-01-01 05:00:00", 3, "b")]
    (tmp_path / "in/x.json").write_text("\n".join(json.dumps(dict(zip(("ts", "event_id", "event_type"), r, strict=True))) for r in rows))
    schema = "ts timestamp, event_id long, event_type string"
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    table = spark.read.schema(schema).json(str(tmp_path / "in"))
    for name, make in (("counts", lambda e: streams.counts(e, "event_type", "1 hour")), ("once", lambda e: streams.distinct(e, "event_id").select("event_id", "event_type")), ("sessions", lambda e: streams.session_counts(e, "event_type", "30 minutes"))):
        mode = "append" if name == "once" else "complete"
        run = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        run.awaitTermination(90)
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, make(table).collect()))
