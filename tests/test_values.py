import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from govlens.functions import sql, values


def clean(value):
    """What cleaning means, on plain objects."""
    if isinstance(value, dict):
        kept = {k: clean(v) for k, v in value.items()}
        return {k: v for k, v in kept.items() if v is not None and v != "" and v != {}}
    if isinstance(value, list):
        return [clean(v) for v in value if v is not None]
    return value


TRICKY = ["", "null", 'a":null,"b', "\\", '\\"', "{}", "[null,", ',"x":"",', "é\n", "plain"]
LEAVES = st.one_of(
    st.none(), st.booleans(), st.integers(-5, 5), st.sampled_from(TRICKY), st.just({}), st.just([])
)
TREES = st.recursive(
    LEAVES,
    lambda inner: st.one_of(
        st.lists(inner, max_size=4),
        st.dictionaries(st.sampled_from(["a", "b", 'k"', "null", ""]), inner, max_size=4),
    ),
    max_leaves=12,
)


def test_clean_json_equals_the_recursive_definition(spark):
    documents = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.dictionaries(st.sampled_from(["a", "b", "c\\", '"']), TREES, max_size=4))
    def gather(document):
        documents.append(json.dumps(document, separators=(",", ":"), ensure_ascii=False))

    gather()
    df = spark.createDataFrame([(d,) for d in documents], "j string")
    for before, after in df.select("j", F.expr(values.clean_json("j"))).collect():
        assert json.loads(after) == clean(json.loads(before)), before


def test_emptied_objects_take_their_parents_along(spark):
    deep = "null"
    for _ in range(30):
        deep = f'{{"a":{deep},"b":""}}'
    df = spark.createDataFrame([(f'{{"keep":1,"x":{deep}}}',)], "j string")
    assert df.select(F.expr(values.clean_json("j"))).first()[0] == '{"keep":1}'


def test_typed_clean(spark):
    df = spark.sql(
        """SELECT named_struct('a', '', 'b', named_struct('c', CAST(NULL AS INT), 'd', ''),
             'l', array('x', NULL, ''), 'e', CAST(array() AS ARRAY<INT>),
             'o', array(named_struct('p', ''), NULL, named_struct('p', 'q'))) AS s"""
    )
    got = df.select(F.to_json(F.expr(values.clean("s", df.schema["s"].dataType)))).first()[0]
    assert json.loads(got) == {"l": ["x", ""], "e": [], "o": [{}, {"p": "q"}]}


def test_cents(spark):
    cases = {
        "100000.000000": 1000.0,
        "0.000000": 0.0,
        " 50 ": 0.5,
        "-1.5e2": -1.5,
        "": None,
        "n/a": None,
        "1d": None,
        "NaN": None,
        None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    for raw, usd in df.select("c", F.expr(values.cents_to_usd("c"))).collect():
        assert usd == cases[raw], raw


def test_event_time(spark):
    cases = {
        "2026-07-16T19:16:51Z": "2026-07-16 19:16:51",
        "2026-07-16T21:16:51+02:00": "2026-07-16 19:16:51",
        "2026-07-13": "2026-07-13 00:00:00",
        " 2026-07-13 ": "2026-07-13 00:00:00",
        "2026-07-16T19:16:51.25Z": "2026-07-16 19:16:51.25",
        "yesterday": None,
        "2026": None,
        "": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    for raw, time in df.select("c", F.expr(values.event_time("c")).cast("string")).collect():
        assert time == cases[raw], raw


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql(
        """SELECT ai_classify('org_sso_configuration_updated', 'resource') AS a,
                  cents_to_usd('250') AS b, glob_match('a.b(c)', 'a.?(*)') AS c,
                  glob_match('axb', 'a.b') AS d, event_time('2026-01-02') AS e"""
    ).first()
    assert (row.a, row.b, row.c, row.d) == ("identity", 2.5, True, False)
    assert str(row.e) == "2026-01-02 00:00:00"


def test_open_json_is_cleaned_at_any_depth(spark):
    from govlens.functions.values import clean_json

    deep = '{"a":' * 40 + "null" + "}" * 40
    texts = [deep, '{"x":1,"y":' + deep + "}", '{"l":[' + deep + ',null],"s":""}', '{"k":"{null}"}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = [r[0] for r in df.selectExpr(clean_json("j")).collect()]
    assert got == ["{}", '{"x":1}', '{"l":[{}]}', '{"k":"{null}"}']
