"""Rows that the tests of this folder share."""

import re

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, empty and very long texts, repeated rows, and characters of several planes.
ODD = [
    (1, None, "en", "a", 0, True), (2, "", "en", None, 0, True), (3, " \n\t ", "en", "a", 4, True), (4, "one two", "en", "b", 7, True), (4, "one two", "en", "b", 7, True),
    (None, "no id here but words", "en", "a", 20, None), (6, "x" * 300_000, "en", "c", 300_000, True), (7, "word " * 60_000, "fr", "c", 300_000, True), (8, "ünï cödé ☃ 👍🏽 A\x00B", "de", "b", 17, True),
]
