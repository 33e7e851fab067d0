import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from captionloom.functions.text import contains_term, format_timestamp, numbers, parse_timestamp, squeeze, strip, to_ms, token_distance, tokens
from captionloom.operators import intervals, metrics


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'bigint'}" for k, v in given.items()))
    return row.select(column.alias("v")).first().v


def fold(t):
    import re

    return [w for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t).casefold())]


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_tokens_fold_like_python(spark):
    texts = [" Olá,  MUNDO! ", "Straße ﬁn", "a_b 1.500", "", "ΣΊΣΥΦΟΣ x²"]
    got = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(tokens(F.col("t")).alias("t")).collect()]
    assert got == [fold(t) for t in texts]


def test_token_distance_against_dynamic_programming(spark):
    r = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    pairs = [([r.choice(words) for _ in range(r.randint(0, 60))], [r.choice(words) for _ in range(r.randint(0, 60))]) for _ in range(40)]
    pairs += [(a, [w if r.random() < 0.8 else "x" for w in a]) for a, _ in pairs]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a array<string>, b array<string>")
    assert [x.d for x in df.orderBy("k").select(token_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [distance(a, b) for a, b in pairs]


@pytest.mark.parametrize(("text", "locale", "want"), [("Ana processou 42 exemplos.", "decimal_comma", ["42"]), ("O total é 1.500,50.", "decimal_comma", ["1500.5"]), ("The total is 1,500.50.", "decimal_point", ["1500.5"]), ("007 x9 9x 1,2,3", "decimal_comma", ["7", "malformed:1,2,3"]), ("100", "decimal_point", ["100"])])
def test_numbers(spark, text, locale, want):
    assert value(spark, numbers(F.col("t"), locale), t=text) == want


def test_terms_and_space(spark):
    assert value(spark, contains_term(F.col("t"), F.lit("Ana")), t="a ANA disse") and not value(spark, contains_term(F.col("t"), F.lit("Ana")), t="Jana")
    assert value(spark, strip(F.col("t")), t=" \x1c a b\n\xa0") == "a b" and value(spark, squeeze(F.col("t")), t=" a \n\t b ") == "a b"


@pytest.mark.parametrize(("seconds", "mark", "want"), [(0.2, ".", "00:00:00.200"), (2.5, ",", "00:00:02,500"), (-3.0, ",", "00:00:00,000"), (360_001.0005, ",", "100:00:01,000"), (0.0025, ",", "00:00:00,002")])
def test_timestamps(spark, seconds, mark, want):
    assert value(spark, format_timestamp(to_ms(F.col("s")), mark), s=seconds) == want
    assert value(spark, parse_timestamp(F.col("t")), t=want) == max(0, round(seconds * 1000))
    assert value(spark, parse_timestamp(F.col("t")), t="00:01.5") is None


ROW = "job_id string, candidate string, seq int, start_ms bigint, end_ms bigint, text string"


def evaluation(spark, reference, candidate, terms, expected):
    ref = spark.createDataFrame([("j", "", k, *s) for k, s in enumerate(reference)], ROW).drop("candidate")
    cand = spark.createDataFrame([("j", "c", k, *s) for k, s in enumerate(candidate)], ROW)
    t, n = (spark.createDataFrame([("j", x) for x in v], f"job_id string, {c} string") for v, c in ((terms, "term"), (expected, "number")))
    return metrics.evaluate(ref, cand, t, n).first()


def test_evaluation_cases(spark):
    same = evaluation(spark, [(0, 1800, " Olá,  MUNDO! ")], [(0, 1800, "olá mundo")], [], [])
    assert (same.wer, same.cer, same.glossary_term_recall, same.timing_iou) == (0, 0, 1, 1)
    ref = [(0, 1800, "Ana disse oi."), (2100, 3900, "Foram 42 casos, Ana.")]
    bad = evaluation(spark, ref, [(700, 2500, "Jana disse oi."), (3000, 4800, "Foram casos, Jana.")], ["Ana", "!!"], ["42"])
    assert (bad.glossary_term_recall, bad.number_recall, bad.punctuation_f1) == (0, 0, 1) and bad.wer == pytest.approx(3 / 7) and bad.timing_iou == pytest.approx(2.4 / 4.8)
    assert bad.cer == pytest.approx(distance("".join(fold(ref[0][2] + ref[1][2])), "janadisseoiforamcasosjana") / len("".join(fold(ref[0][2] + ref[1][2]))))
    split = evaluation(spark, [(0, 1800, "a"), (2000, 3800, "b")], [(0, 900, "a"), (900, 1800, ""), (2000, 3800, "b")], [], [])
    assert split.timing_iou == 1 and split.wer == 0
    assert evaluation(spark, [(0, 0, "")], [(0, 0, "")], [], []).wer == 0 and evaluation(spark, [(0, 0, "")], [(0, 5, "a")], [], []).cer == 1


def test_gates_score_and_winner(spark):
    names = "job_id string, candidate string, wer double, cer double, glossary_term_recall double, number_recall double, punctuation_f1 double, timing_iou double"
    rows = [("j", "lower_wer", 0.05, 0.14, 1.0, 1.0, 0.0, 0.5), ("j", "lower_score", 0.06, 0.0, 1.0, 1.0, 1.0, 1.0), ("k", "a", 0.3, 0.0, 1.0, 1.0, 1.0, 1.0), ("k", "b", 0.3, 0.0, 1.0, 1.0, 1.0, 1.0), ("l", "x", 0.1, 0.0, 1.0, 1.0, 1.0, 1.0), ("m", "b", 0.1, 0.0, 1.0, 1.0, 1.0, 1.0), ("m", "native", 0.1, 0.1, 1.0, 1.0, 1.0, 1.0)]
    e = spark.createDataFrame(rows, names)
    scores = {r.candidate: r.score for r in metrics.gated(e).filter("job_id = 'j'").collect()}
    assert scores == {"lower_wer": pytest.approx(0.199), "lower_score": pytest.approx(0.06)}
    won = {r.job_id: (r.selected, r.code) for r in metrics.select_winner(e).collect()}
    assert won == {"j": ("lower_wer", None), "k": (None, "ASR_QUALITY_GATES_FAILED"), "l": (None, "ASR_CANDIDATES_INSUFFICIENT"), "m": ("native", None)}
    assert metrics.selected_candidates(metrics.select_winner(e), "only").select("selected").distinct().collect()[0].selected == "only"
    assert [r.candidate for r in metrics.ranked(e).filter("job_id = 'm'").orderBy("place").collect()] == ["native", "b"]


def test_intervals_against_plain_python(spark):
    r = random.Random(3)
    rows = [(j, s := r.randint(0, 400), s + r.randint(-2, 40)) for j in range(5) for _ in range(30)]
    df = spark.createDataFrame(rows, "j int, start bigint, end bigint")
    got = {(x.j, x.start, x.end) for x in intervals.merge_intervals(df, ["j"]).collect()}
    want = set()
    for j in range(5):
        covered = {x / 2 for jj, s, e in rows if jj == j and e > s for x in range(2 * s, 2 * e + 1)}
        points = sorted(covered)
        starts = [p for p in points if p - 0.5 not in covered]
        ends = [p for p in points if p + 0.5 not in covered]
        want |= {(j, int(a), int(b)) for a, b in zip(starts, ends, strict=True)}
    assert got == want
    a = intervals.merge_intervals(df, ["j"])
    b = intervals.merge_intervals(df.withColumn("start", F.col("start") + 7).withColumn("end", F.col("end") + 7), ["j"])
    for width in (10, 10_000):
        common = {x.j: x.overlap for x in intervals.overlap_lengths(a, b, ["j"], width).collect()}
        for j in range(5):
            one = {p for jj, s, e in want if jj == j for p in range(s, e)}
            assert common[j] == len(one & {p + 7 for p in one})
    bad = spark.createDataFrame([(1, float("nan"), 2.0), (1, 0.0, float("inf")), (1, 1.0, 2.0), (1, 2.0, 3.0)], "j int, start double, end double")
    assert [tuple(x) for x in intervals.merge_intervals(bad, ["j"]).collect()] == [(1, 1.0, 3.0)]
