"""JSON while it is written, and streams that are late, broken and repeated."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import growing
from foliant.plans import streaming_queries
from foliant.streaming import metering, passthrough

PLAN = '{"language":"English","title":"say \\"concepts\\": [{","goals":[{"a":1}],"concepts":[{"name":"A {[","description":"d\\\\","parts":[{"x":"}]"}]},{"name":"B"}]}'
FIRST = PLAN[PLAN.index('{"name":"A') : PLAN.index(',{"name":"B"')]


def feed(chunks, name="concepts"):
    """The element and the number of characters after which it came; the state goes through text between chunks."""
    state, found, at = "", [], 0
    for c in chunks:
        scan = growing.FirstElement(name, state)
        out = scan.feed(c)
        at += len(c)
        if out is not None:
            found.append((out, at, dict(scan.fields)))
        state = scan.state()
    return found


def test_every_prefix_gives_null_or_the_same_element():
    end = PLAN.index(FIRST) + len(FIRST)
    for cut in range(len(PLAN) + 1):
        found = feed([PLAN[:cut]])
        assert [f[0] for f in found] == ([FIRST] if cut >= end else [])
    assert feed(list(PLAN)) == [(FIRST, end, {"language": "English", "title": 'say "concepts": [{'})]
    for size in (2, 3, 7, 50):
        assert [f[0] for f in feed([PLAN[k : k + size] for k in range(0, len(PLAN), size)])] == [FIRST]


def test_lists_that_have_no_first_element():
    for text in ("", '{"title":"x"', '{"concepts":[', '{"concepts":[1, "a"]}', '{"concepts":{"a":1}}', '{"x":{"concepts":[{"a":1}]}}', '{"x":[{"concepts":[{"a":1}]}]}', '{"title":"concepts","y":[{"a":1}]}', "no json", "[[{}]]"):
        assert feed([text]) == [], text
    assert feed(['{"concepts":[{"a":1}'])[0][0] == '{"a":1}'


def test_figures_that_can_be_drawn(spark):
    cases = [
        ('{"type":"flow","steps":["a","b"]}', True), ('{"type":"flow","steps":["only one"]}', False), ('{"type":"flow","steps":"ab"}', False), ('{"type":"flow"}', False), ('{"type":"sculpture"}', False), ('{"type":7}', False),
        ('{"type":"bar","bars":[{"label":"x","value":1}]}', True), ('{"type":"bar","bars":[{"label":"x","value":"many"}]}', False), ('{"type":"bar","bars":[{"value":1}]}', False), ('{"type":"bar","bars":[1]}', False), ('{"type":"bar","bars":[]}', False),
        ('{"type":"group","items":[{"type":"flow","steps":["a","b"]}]}', True), ('{"type":"group","items":[{"type":"group","items":[]}]}', False), ('{"type":"group","items":[]}', False), ("[]", False), ("no", False), (None, False), ("3", False),
        ('{"type":"slider","min":0,"max":10,"outputs":[{"label":"x","expr":"window.location"}]}', False), ('{"type":"slider","min":10,"max":1,"outputs":[{"label":"x","expr":"x"}]}', False), ('{"type":"slider","variable":"b","min":1,"max":12,"value":99,"constants":{"h":6},"outputs":[{"expr":"b*h/2"},{"expr":"b @@ 2"}]}', True), ('{"type":"slider","min":"a","max":[],"outputs":3}', False),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "id long, spec string")
    assert {r.id for r in growing.visuals(df, "id", "spec").collect()} == {k for k, c in enumerate(cases) if c[1]}
    good = growing.slider(cases[-2][0])
    assert good["value"] == 12 and good["constants"] == {"h": 6.0} and len(good["outputs"]) == 1


def test_the_opening_of_a_lesson(spark):
    lesson = {"hook": {"text": 'h "q"'}, "prediction": {"question": "p"}, "cards": [{"idea": "C0"}], "quiz": [1], "summary": {}}
    df = spark.createDataFrame([(1, json.dumps(lesson)), (2, "[]"), (3, '{"cards": [1'), (4, None), (5, "{}")], "id long, lesson string")
    got = {r.id: r.o for r in df.select("id", growing.opening(F.col("lesson")).alias("o")).collect()}
    assert json.loads(got[1]) == {"hook": {"text": 'h "q"'}, "prediction": {"question": "p"}, "cards": [], "quiz": []}
    assert got[2] is got[3] is got[4] is None and json.loads(got[5]) == {"cards": [], "quiz": []}


def sse(*events):
    return "".join(f"data: {json.dumps(e)}\n\n" for e in events)


START = {"type": "message_start", "message": {"usage": {"input_tokens": 12, "output_tokens": 1}}}
DELTA = {"type": "message_delta", "usage": {"output_tokens": 30}}
STOP = {"type": "message_stop"}
CHUNK = "stream_id bigint, seq bigint, chunk string, ts timestamp"


@pytest.fixture
def live(spark, tmp_path):
    """Runs `build` over files of rows, each a batch of its own, and gives all that came out."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(build, *batches, schema=CHUNK):
        place = tmp_path / "in"
        for k, rows in enumerate(batches):
            frame = spark.createDataFrame(rows, schema.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds("s")).drop("s")
            frame.coalesce(1).write.parquet(str(place / f"b{k}"))
        source = spark.readStream.schema(spark.read.parquet(str(place / "b0")).schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(place / "*"))
        return metering.finished(build(source), "append").collect()

    yield run
    spark.conf.set("spark.sql.shuffle.partitions", "4")


DAYS = 86_400


def test_late_broken_and_repeated_streams(live):
    whole = sse(START, DELTA, STOP)
    first, second = whole[:40], whole[40:]
    rows = live(
        passthrough.passed_through,
        [(1, 1, second, 10), (2, 0, sse(START) + "data: cut", 10), (3, 0, "no usage", 10)],  # 1: the end comes first
        [(1, 0, first, 20), (1, 1, second, 20), (2, 1, " off", 30)],  # repeated
        [(1, 2, "after the end", 40), (9, 0, "x", 5 * DAYS)],  # time goes on
        [(9, 1, "y", 5 * DAYS + 1)],
    )
    chunks = sorted((r.stream_id, r.seq, r.chunk) for r in rows if r.kind == "chunk")
    assert chunks == sorted([(1, 0, first), (1, 1, second), (1, 2, "after the end"), (2, 0, sse(START) + "data: cut"), (2, 1, " off"), (3, 0, "no usage"), (9, 0, "x"), (9, 1, "y")])
    usage = sorted((r.stream_id, r.input, r.output, r.broken) for r in rows if r.kind == "usage")
    assert usage == [(1, 12, 30, False), (2, 12, 1, True)]


def test_first_concepts_while_they_come_in(live, spark):
    parts = [PLAN[:30], PLAN[30:90], PLAN[90:]]
    rows = live(passthrough.first_concept_stream, [(1, 2, parts[2], 10), (2, 0, parts[0], 10)], [(1, 0, parts[0], 20)], [(1, 1, parts[1], 30), (2, 1, parts[1], 30)])
    assert [(r.stream_id, r.at, r.language, r.concept) for r in rows] == [(1, 2, "English", FIRST)]
    batch = spark.createDataFrame([(1, k, p) for k, p in enumerate(parts)] + [(2, 0, parts[0]), (3, 0, None)], "stream_id long, seq long, chunk string")
    assert [(r.stream_id, r.at, r.concept) for r in growing.first_concepts(batch).collect()] == [(1, 2, FIRST)]


def test_quotas_by_kind_and_period(live):
    call = "event_id bigint, user_id bigint, ts timestamp, kind string, trial boolean, courses long, lessons long"
    rows = [(k, 1, 10 + k, kind, False, 1, 2) for k, kind in enumerate(("course", "lesson", "course", "lesson", "lesson"))]
    later = [(10, 1, 40 * DAYS, "course", False, 1, 2), (11, 2, 40 * DAYS, "course", True, 1, 2), (12, 2, 80 * DAYS, "course", True, 1, 2)]
    got = {r.event_id: (r.period, r.verdict) for r in live(passthrough.quota_stream, rows[:2], rows[2:], later, schema=call)}
    assert {k: v for k, (_, v) in got.items()} == {0: "ok", 1: "ok", 2: "course_quota", 3: "ok", 4: "lesson_quota", 10: "ok", 11: "ok", 12: "course_quota"}
    assert got[10][0] == "1970-02" and got[12][0] == "trial"


def test_stream_and_batch_give_the_same_verdicts(spark, sf):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(streaming_queries.stream_quota_verdicts(spark, sf)) == key(streaming_queries.quota_verdicts(spark, sf))


@pytest.fixture
def by_the_few(spark):
    """Rows are handed to Python three at a time, so that a group comes in several parts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_verdicts_of_groups_that_come_in_parts(live, by_the_few):
    call = "event_id bigint, user_id bigint, ts timestamp, kind string, trial boolean, courses long, lessons long"
    rows = [(k, u, 1000 - 10 * k, "lesson", False, 1, 4) for k in range(10) for u in (1, 2)]  # the latest first
    got = [(r.user_id, r.event_id) for r in live(passthrough.quota_stream, rows, schema=call) if r.verdict == "ok"]
    assert sorted(got) == [(u, k) for u in (1, 2) for k in range(6, 10)]


def test_calls_are_numbered_in_their_order_with_a_state_for_each_user(live, by_the_few):
    event = "event_id bigint, user_id bigint, ts timestamp"
    rows = [(k, 1, 1000 - 10 * k) for k in range(5)] + [(20 + k, 1, DAYS + k) for k in range(2)] + [(30, 2, 5)]
    more = [(10, 1, 2000), (22, 1, DAYS + 9), (31, 2, 3 * DAYS), (40, 1, 30 * DAYS)]
    got = {r.event_id: (r.user_id, r.day, r.nth, r.ok) for r in live(lambda e: metering.allowed_calls(e, 3), rows, more, [(41, 1, 30 * DAYS + 1), (42, 2, 29 * DAYS + 5)], schema=event)}
    assert [got[k][2:] for k in range(5)] == [(5 - k, k >= 2) for k in range(5)] and got[10] == (1, "1970-01-01", 6, False)
    assert [got[k] for k in (20, 21, 22)] == [(1, "1970-01-02", n, True) for n in (1, 2, 3)]
    assert got[30] == (2, "1970-01-01", 1, True) and got[31][2:] == (1, True) and got[40][2:] == (1, True) and got[41][2:] == (2, True) and got[42][1:] == ("1970-01-30", 1, True)
