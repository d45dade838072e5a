"""Column builders on hand-written rows (including traps T1, T2)."""

from pyspark.sql import functions as F

from leadloom.functions import (classify_phone, clean_phone, is_valid_phone, name_key,
                                normalize_phone, py_strip, clean_line)


def one_col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_classify_phone(spark):
    cases = {
        "012-345 6789": "mobile", "+6012 3456789": "mobile", "60123456789": "mobile",
        "019.1234567": "mobile", "03-1234 5678": "landline", "+603 1234 5678": "landline",
        "(012) 3456789": "landline",   # parentheses are kept -> not a mobile prefix
        "60": "landline", "6": "landline", "": "", None: "", "   ": "", "010": "mobile",
        "0101": "mobile", "01-": "landline", " 012 3456789": "mobile",
    }
    got = one_col(spark, list(cases), classify_phone)
    assert got == list(cases.values())


def test_clean_and_normalize(spark):
    vals = ["+60 12-345 6789", "+012345678", "6012345678", "601234567", "03-1234 5678",
            "tel: +603 1234", "", None, "١٢"]
    assert one_col(spark, vals, clean_phone) == [
        "+60123456789", "+012345678", "6012345678", "601234567", "0312345678", "+6031234", "", "",
        "١٢"]
    assert one_col(spark, vals, normalize_phone) == [
        "0123456789", "012345678", "012345678", "601234567", "0312345678", "031234", "", "",
        "١٢"]


def test_is_valid_phone(spark):
    vals = ["0123456789", "012345678", "01234567", "0123456789012", "012345678901",
            "60123456789", "123456789", "", "+60 12-345 6789"]
    assert one_col(spark, vals, is_valid_phone) == [True, True, False, False, True, True,
                                                    False, False, True]


def test_name_key_suffix_order_and_inner_hits(spark):
    vals = ["Firm 7 Sdn Bhd", "FIRM 7 SDN. BHD.", "Firm 7, Plt", "Firm-7 (M) Bhd",
            "  Firm  7 ", "Firm 7 Sdn. Bhd",      # T1: 'sdn' stays
            "Bhdrama Studio",                     # T2: removal inside a word
            "Kedai (Malaysia) LLP.", "!!!", "", None, "Café  Ünïcode_x", "a  b"]
    assert one_col(spark, vals, name_key) == [
        "firm 7", "firm 7", "firm 7", "firm7", "firm 7", "firm 7 sdn", "rama studio",
        "kedai", "", "", "", "café ünïcode_x", "a b"]


def test_strip_and_clean_line(spark):
    vals = ["  a b  ", "　x ", " café — x ", "\tz"]
    assert one_col(spark, vals, py_strip) == ["a b", "x", "café — x", "z"]
    # strip first, then drop non-ASCII: inner blanks next to removed characters stay
    assert one_col(spark, vals, clean_line) == ["a b", "x", "caf  x", "z"]
