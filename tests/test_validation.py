"""Validation messages, their order, quarantine, and scoring-request checks."""
import pytest
from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.operators import scaling as SC
from cohortlens.operators import scoring as SCO
from cohortlens.operators import validate as V
from cohortlens.sources import files
from support import HEADER


def _raw(spark, rows, cols=None):
    cols = cols or S.REQUIRED_PUBLIC
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


@pytest.fixture(scope="module")
def malformed_csv(tmp_path_factory):
    """A byte-order mark, Windows line ends, three blank genders and a last line that is nearly empty."""
    rows = [[i, "Male" if i % 2 else "Female", 20 + i % 40, 30 + i % 60, 1 + i % 100] for i in range(1, 301)]
    for i in (132, 144, 240):
        rows[i][1] = ""
    lines = [HEADER, *(",".join(map(str, r)) for r in rows), "Female,,,,"]
    path = tmp_path_factory.mktemp("bad") / "20260320_135146_Customers.csv"
    path.write_bytes(("\ufeff" + "\r\n".join(lines) + "\r\n").encode())
    return str(path)


def test_malformed_upload_is_rejected_with_gender_message(spark, malformed_csv):
    raw = files.read_customer_csv(spark, malformed_csv)
    with pytest.raises(V.ValidationError) as e:
        V.validate(raw)
    assert str(e.value) == "Gender column must contain only Male or Female values. Found: Nan"


def test_quarantine_keeps_good_rows(spark, malformed_csv):
    good, bad = V.quarantine(files.read_customer_csv(spark, malformed_csv))
    assert good.count() == 297
    assert {r["reject_reason"] for r in bad.collect()} == {"invalid_gender"} and bad.count() == 4


def test_float_formatted_upload_is_accepted(spark):
    df = V.validate(_raw(spark, [("1.0", "Male", "66.0", "15.5", "39.0")] * 5))
    assert df.count() == 5
    assert dict(df.dtypes)[S.AGE] == "smallint"


def test_large_ids_pass_validation_and_scoring(spark):
    df = V.validate(_raw(spark, [("5000000000", "Male", "66", "88", "82")] * 5))
    scored = SCO.score(df, SCO.fixed_center_model(SC.fit_standard(df))).collect()
    assert {(r[S.CUSTOMER_ID], r["segment"]) for r in scored} == {(5_000_000_000, S.VIP)}


def test_numbers_must_be_decimal_and_blanks_may_be_unicode(spark):
    rows = [(v, "\u00a0male\u2003", "20", "15", "39") for v in ("12d", "12f", "0x1p3", "1e2", " 7 ", "1_0", "+3.", ".5")]
    norm = V.normalize(_raw(spark, rows))
    assert [r["customer_id_num"] for r in norm.collect()] == [None, None, None, 100.0, 7.0, None, 3.0, 0.5]
    assert {r[S.GENDER] for r in norm.collect()} == {"Male"}


def test_missing_columns(spark):
    raw = _raw(spark, [("1", "Male", "20", "15")], S.REQUIRED_PUBLIC[:4])
    with pytest.raises(V.ValidationError) as e:
        V.validate(raw)
    assert str(e.value).endswith("Missing: Spending Score (1-100)")


def test_empty_and_too_few(spark):
    with pytest.raises(V.ValidationError, match="empty"):
        V.validate(_raw(spark, []))
    with pytest.raises(V.ValidationError, match="at least 5 rows"):
        V.validate(_raw(spark, [("1", "Male", "20", "15", "39")] * 4))


def test_check_order_and_messages(spark):
    base = [("1", "Male", "20", "15", "39")] * 5
    cases = [
        ([("2", "robot", "20", "15", "39"), ("3", " female ", "x", "15", "39")], "Found: Robot"),
        ([("2", "Male", "abc", "15", "39")], S.MSG_NUMERIC),
        ([("2", "Male", "0.7", "15", "39")], S.MSG_AGE),        # truncated to 0 before the range check
        ([("2", "Male", "100.7", "-1", "39")], S.MSG_INCOME),   # 100.7 -> 100 is a valid age
        ([("2", "Male", "40", "15", "100.5")], S.MSG_SCORE),
        ([("2", "Male", "40", "inf", "50")], S.MSG_NUMERIC),    # non-finite income is rejected
    ]
    for extra, msg in cases:
        with pytest.raises(V.ValidationError) as e:
            V.validate(_raw(spark, base + extra))
        assert msg in str(e.value)


def test_first_five_sorted_offenders(spark):
    rows = [("1", g, "20", "15", "39") for g in ["zeta", "alpha", "Male", "x", "beta", "gamma", "delta", "", "NA"]]
    summary = V.summary(_raw(spark, rows)).first()
    assert summary["invalid_genders"] == "Alpha, Beta, Delta, Gamma, Nan"


def test_request_rejections(spark):
    rows = [(0, 30.0, 50.0), (101, 30.0, 50.0), (30, -1.0, 50.0), (30, 301.0, 50.0),
            (30, 30.0, 0.0), (30, 30.0, 101.0), (30, float("nan"), 50.0), (30, 30.0, float("nan")),
            (33, 87.0, 82.0)]
    req = spark.createDataFrame(rows, "age int, income double, score double")
    got = [r["reject_reason"] for r in SCO.validate_requests(req).collect()]
    assert got == [S.MSG_REQ_AGE, S.MSG_REQ_AGE, S.MSG_REQ_INCOME, S.MSG_REQ_INCOME, S.MSG_REQ_SCORE,
                   S.MSG_REQ_SCORE, S.MSG_REQ_INCOME, S.MSG_REQ_SCORE, None]


def test_dataset_health_counts_missing(spark):
    raw = _raw(spark, [("1", None, "20", "NA", "39"), ("2", "Male", None, None, "nan")])
    r = V.dataset_health(raw).first()
    assert (r["dataset_rows"], r["dataset_cols"], r["missing_values"]) == (2, 5, 5)


def test_uploads_bind_by_column_name(spark, malformed_csv, tmp_path):
    import shutil
    shutil.copy(malformed_csv, tmp_path)
    (tmp_path / "20260101_000000_other.CSV").write_text(
        "Note,CustomerID,Gender,Spending Score (1-100),Annual Income (k$),Age\nx,1,Male,90,40,30\n")
    (tmp_path / "20260101_000001_less.csv").write_text("CustomerID,Gender,Age,Annual Income (k$)\n1,Male,30,40\n")
    (tmp_path / "20260101_000002_none.csv").write_text("1,Male,30,40,50\n")
    (tmp_path / "readme.txt").write_text("CustomerID\n")
    land = files.read_landing(spark, str(tmp_path))
    assert {r["upload_label"] for r in land.select("upload_label").distinct().collect()} == {"Customers", "other", "less", "none"}
    norm = V.normalize(land).withColumn("reject_reason", V.reject_reason(F.col("missing_columns")))
    rows = {label: [r for r in norm.collect() if r["upload_label"] == label] for label in ("Customers", "other", "less", "none")}
    assert len(rows["Customers"]) == 301 and sum(r["reject_reason"] is not None for r in rows["Customers"]) == 4
    (r,) = rows["other"]
    assert (r["age_num"], r["score_num"], r["income_k_num"], r["reject_reason"]) == (30.0, 90.0, 40.0, None)
    assert [(r["reject_reason"], r["missing_columns"]) for r in rows["less"]] == [("missing_columns", "Spending Score (1-100)")]
    assert [r["reject_reason"] for r in rows["none"]] == ["missing_columns"]
    assert str(rows["other"][0]["arrival_ts"]) == "2026-01-01 00:00:00"


def test_uploads_of_any_width_with_quotes_and_line_breaks(spark, tmp_path):
    """Headers of 300 columns; quoted names, commas, doubled quotes and line breaks; stray quotes; a blank in a file's name."""
    wide = [f"Extra {i}" for i in range(295)]
    (tmp_path / "20260102_000000_wide.csv").write_text(
        ",".join([*wide, *S.REQUIRED_PUBLIC]) + "\n" + ",".join(["x"] * 295 + ["1", "Male", "30", "40", "50"]) + "\n\n")
    (tmp_path / "20260102_000001_quoted.csv").write_text(
        '"CustomerID","Gender","Note","Age","Annual Income (k$)","Spending Score (1-100)"\n'
        '"2","Female","a, ""b""","31","41","51"\n3,Male,"",32,42,52\n')
    (tmp_path / "20260102_000002_broken [1] lines.csv").write_text(
        'CustomerID,Note,Gender,Age,Annual Income (k$),Spending Score (1-100)\n'
        '4,"two\nlines, one ""field""",Male,33,43,53\n5,a 5" pipe,Male,34,44,54\n6,"\n\n",Female,35,45,55\n')
    land = files.read_landing(spark, str(tmp_path))
    got = sorted((r["upload_label"], *(r[c] for c in S.REQUIRED_PUBLIC), r["missing_columns"]) for r in land.collect())
    assert got == [("broken [1] lines", "4", "Male", "33", "43", "53", None), ("broken [1] lines", "5", "Male", "34", "44", "54", None),
                   ("broken [1] lines", "6", "Female", "35", "45", "55", None), ("quoted", "2", "Female", "31", "41", "51", None),
                   ("quoted", "3", "Male", "32", "42", "52", None), ("wide", "1", "Male", "30", "40", "50", None)]


def test_fields_of_a_line(spark):
    lines = ['a,b', '', ',', 'a,,"c,d"', '"x ""y""",""', ' 1 , "2"', 'a""b,c', '"open', 'in"ch', '"a"b,c', 'x\x01']
    df = spark.createDataFrame([(v,) for v in lines], "v string")
    got = {r.v: (r.f if r.ok else None) for r in df.select("v", files._split(F.col("v")).alias("f"), files._well_formed(F.col("v")).alias("ok")).collect()}
    assert got == {'a,b': ["a", "b"], '': [None], ',': [None, None], 'a,,"c,d"': ["a", None, "c,d"], '"x ""y""",""': ['x "y"', ""],
                   ' 1 , "2"': None, 'a""b,c': ['a""b', "c"], '"open': None, 'in"ch': None, '"a"b,c': None, 'x\x01': None}
