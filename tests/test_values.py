import pytest
from pyspark.sql import functions as F

from tessera.functions import grams, text, values


@pytest.mark.parametrize("said", ["470백만원", "4억 7천만 원", "470,000,000원", "사억칠천만 원"])
def test_equal_amounts(said):
    assert values.amounts_py(said) == {470_000_000}


@pytest.mark.parametrize("said", ["조사 일정", "제3조의2", "9,999원", "", None])
def test_no_amount(said):
    assert values.amounts_py(said) == set()


def test_corrected_amount():
    assert values.amounts_py("5억이 아니라 1억 3천만 원") == {500_000_000, 130_000_000}


def test_periods():
    assert values.periods_py("2024-12-31") == values.periods_py("‘24년 12월 31일") == {("날짜", "2024-12-31")}
    assert values.periods_py("2024.02.31 이후 3개월 120일") == {("날짜", "2024-02-31"), ("개월", "3"), ("일", "120")}


@pytest.mark.parametrize(("said", "cited"), [("[1][3]", {1, 3}), ("[1, 2]", {1, 2}), ("[3-1]", {1, 2, 3}), ("[출처: 1]", {1}), ("[1번]", {1}), ("【1】", {1}), ("(1)", set())])
def test_citations(spark, said, cited):
    assert set(spark.createDataFrame([(said,)], "a string").select(values.citations(F.col("a"))).first()[0]) == cited


def test_bigrams_match_python(spark):
    for said in ("a bcd", "Été é _a1 가나다 ①²x", "Straße ẞ"):
        got = spark.createDataFrame([(said,)], "a string").select(text.bigrams(F.col("a"))).first()[0]
        assert got == text.bigrams_py(said)


@pytest.mark.parametrize("said", ["a bcd", "Été é _a1 가나다 ①²x", "Straße ẞ", "", "x\ny", "  "])
def test_numbered_grams(said):
    code, row = grams.grams(["ab", said, "c"])
    assert [grams.gram_text(c) for c in code[row == 1].tolist()] == text.bigrams_py(said)


def test_clean(spark):
    raw = "사 업 명\n목차 ······· 3\n\n\n\n- 이 하 여 백 -\n사 업 비: 금\x07 1원　끝 "
    got = spark.createDataFrame([(raw,)], "a string").select(text.clean(F.col("a"))).first()[0]
    assert got == "사업명\n목차 3\n\n사업비: 금 1원 끝"


def test_keyword_present(spark):
    rows = spark.createDataFrame([("2024-12-31", "‘24년 12월 31일까지", True), ("제안 서", "제 안서 제출", True), ("1억 3천만 원", "130,000천원", True), ("없음", "있음", False)], "k string, t string, want boolean")
    assert all(r[0] == r[1] for r in rows.select("want", values.keyword_present(F.col("k"), F.col("t"))).collect())


def test_filter_key(spark):
    assert spark.createDataFrame([("서울특별시 여성-재단",)], "a string").select(text.filter_key(F.col("a"))).first()[0] == "서울시여성재단"


def column(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def test_values_in_the_jvm(spark):
    assert column(spark, ["470백만원", "5억이 아니라 1억 3천만 원", "조사 일정", None], values.amounts) == [[470_000_000], [130_000_000, 500_000_000], [], []]
    won = {"130,000,000원": 130_000_000, "40,000천원": 40_000_000, "196백만원": 196_000_000, "1억 5천만 원": 150_000_000, "￦ 60,000,000": 60_000_000, "50,000,000(VAT포함)": 50_000_000, "없음": None}
    assert column(spark, list(won), values.won) == list(won.values())
    said = {"해당 내용은 확인되지 않습니다.": True, "예산은 1억 원이며 기간은 확인되지 않습니다": False, "기간은 3개월입니다 [1]. 세부 일정은 확인되지 않습니다.": False, "사업명을 알려주십시오.": True}
    assert column(spark, list(said), values.is_refusal) == list(said.values())


def test_fields(spark):
    text = "1. 사업 예산 : 금 130,000,000원 ○ 기타\n사업기간: 계약일로부터 120일\n계약 방법 | 제한경쟁입찰 |\n"
    found = column(spark, [text, "없음"], values.fields)
    assert found[0] == {"원문 사업 예산": "금 130,000,000원", "원문 사업 금액": "130000000", "원문 사업 기간": "계약일로부터 120일", "원문 계약 방법": "제한경쟁입찰"}
    assert set(found[1].values()) == {""}
