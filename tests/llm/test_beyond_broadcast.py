"""The same results when no side is small enough to be broadcast."""

from test_against_brute_force import test_licenses as license_case
from test_against_brute_force import test_line_dedup as line_case
from test_against_brute_force import test_ngram_join as join_case

from lodestone.llm import licenses, storage


def test_lines(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", -1)
    line_case(spark)


def test_join(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", -1)
    join_case(spark)


def test_licenses(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_POSITIONS", -1)
    license_case(spark)
