from datetime import date

from pyspark.sql import functions as F

from basalt.functions import dates as D
from basalt.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'date' if isinstance(v, date) else 'int'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).collect()[0]["x"]


def test_dates(spark):
    day = date(2026, 6, 10)  # a Wednesday
    cases = {"다음주 일정": (date(2026, 6, 15), date(2026, 6, 21)), "이번 주": (date(2026, 6, 8), date(2026, 6, 14)), "지난주": (date(2026, 6, 1), date(2026, 6, 7)), "최근 3일": (date(2026, 6, 8), day)}
    for text, (first, last) in cases.items():
        assert tuple(one(spark, D.phrase_range(F.col("t"), F.col("d")), t=text, d=day)) == (first, last), text
    assert one(spark, D.phrase_range(F.col("t"), F.col("d")), t="hello", d=day) is None
    for text, want in {"2026.2.3": date(2026, 2, 3), "26-2-3": date(2026, 2, 3), "2/3": date(2026, 2, 3), "2026.2.30": None, "오늘": day, "x": None}.items():
        assert one(spark, D.parsed_date(F.col("t"), F.col("d")), t=text, d=day) == want, text


def test_clock(spark):
    for text, want in {"오후 2시 30분": 870, "오전 12시": 0, "9:05": 545, "14": 840, "2:30 pm": 870, "": None, "99": None}.items():
        assert one(spark, D.minutes_of(F.col("t")), t=text) == want, text
    assert tuple(one(spark, D.clock_range(F.col("t")), t="9:00 ~ 8:00")) == (540, 480, None)
    for text, want in {"9h 30m": 570, "9시간": 540, "45분": 45, "1:15": 75, "x": None}.items():
        assert one(spark, D.duration_minutes(F.col("t")), t=text) == want, text
    assert [one(spark, D.backoff_seconds(F.col("n")), n=n) for n in (0, 1, 2, 3, 7, 50)] == [5, 5, 10, 20, 300, 300]
    assert one(spark, D.zero_duration(F.col("t")), t="0시간 0분") and not one(spark, D.zero_duration(F.col("t")), t="0:10")


def test_text(spark):
    assert one(spark, T.title_key(F.col("t")), t="[공고] Smart-Factory 2026!") == "smartfactory2026"
    assert one(spark, T.slug(F.col("t")), t="") == "untitled"
    assert one(spark, T.url_key(F.col("t")), t="HTTPS://A.b/C%20d#x") == "https://a.b/c d"
    assert one(spark, T.same_site(F.lit("https://www.a.com/x"), F.lit("http://m.a.com"))) is True
    assert one(spark, T.citations(F.col("t"), F.lit(3)), t="a [2][9][1][2]") == [2, 1]
    assert one(spark, T.links_used(F.col("t")), t="<links_used>1:2,3;2:1</links_used>") == {1: [2, 3], 2: [1]}
    assert one(spark, T.answer_text(F.col("t")), t="<answer>a</answer>x<answer> b</answer>") == "a\n\nb"
    assert one(spark, T.safe_prefix(F.col("t")), t="text <ans") == "text "
    assert one(spark, T.json_object(F.col("t")), t='x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    assert one(spark, T.json_array(F.col("t"), "results"), t='{"results": [1, 2]}') == "[1,2]"
    assert one(spark, T.title_path(F.array(*map(F.lit, ("a", "a", "b", ""))))) == "a > b"
    assert one(spark, T.distinct_folded(F.array(*map(F.lit, ("A b", "a  B", "", "c"))))) == ["A b", "c"]
    assert one(spark, T.html_text(F.lit("<p>a</p><script>x</script><p>a</p><p> b &amp; c</p>"))) == "a\nb & c"
    assert one(spark, T.upload_path(F.lit("tax"), F.lit("2026-01-02"), F.lit("Kim / Lee"), F.lit('a:b?c'), F.lit(".pdf"))) == "tax/2026-01-02/Kim%20Lee/a%20b%20c.pdf"
