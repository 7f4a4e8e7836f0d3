"""Text queries read whole texts, and languages are told where neither script passes a tenth."""

from evidrel import plans
from evidrel.functions import text as X


def test_whole_texts_are_read(spark, tmp_path):
    text = "An opening sentence of plain English. " * 20 + "茅台" * 400 + "。  Then the end.  "
    spark.createDataFrame([(1, text, "en", "src1", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    language = {r.id: r for r in plans.QUERIES["s20_language"](spark, str(tmp_path)).collect()}[101]
    assert (language.lang, language.chat, language.eval) == ("mixed", "zh", "zh")
    assert plans.QUERIES["s24_sentences"](spark, str(tmp_path)).first().n == 21
    assert plans.QUERIES["s29_s32_clean"](spark, str(tmp_path)).first().clean == " ".join(text.split())


def test_language_of_few_letters(spark):
    digits = "0123456789" * 20
    cases = [(digits + " the 7 and 8", "en"), (digits + " 是 7 的 8", "zh"), (digits + "。！", "zh"), (digits + "(7)-", "en"), (digits + " 7", "unknown"), (digits + ".", "unknown"), (digits + "x" * 16 + "茅" * 16 + " the and", "mixed"), ("", "unknown"), (None, "unknown")]
    rows = spark.createDataFrame(cases, "t string, want string").select("t", "want", X.detect_language(X.F.col("t")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_other_characters_go_a_run_at_a_time(spark):
    texts = ["", None, "a1b22c", "茅台 abc 茅", "!?" * 50_000, "x" * 100_000 + "é😀", "\n \n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.count_of(X.F.col("t"), "A-Za-z").alias("latin"), X.count_of(X.F.col("t"), X.CJK).alias("cjk")).collect()
    assert [(r.latin, r.cjk) for r in rows] == [(None, None) if t is None else (sum(c.isascii() and c.isalpha() for c in t), sum("一" <= c <= "\u9fff" for c in t)) for t in texts]
    assert "]+" in str(X.count_of(X.F.col("t"), "a"))  # one replacement a run, not one a character
