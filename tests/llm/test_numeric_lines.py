"""Lines whose fields are mostly numbers, the log lines of which the template tree is named."""

from cohortwave.llm import line_dedup


def test_lines_of_mostly_numbers_have_templates(spark):
    rows = []
    for i in range(12):
        own = f"document {chr(97 + i)} says something of its own about {chr(97 + i) * 5}"
        rows.append((i, f"{own}\nerror {i * 7} {i * 3 + 1} {1000 - i}\ntook 10:{i}:33 {i} {i + 5} {i * i} ms now\n{i} {i + 1} {i + 2}"))
    got = {r.doc_id: r for r in line_dedup.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_dropped == 0
    for i in range(1, 12):
        # numbers alone are no template
        assert got[i].n_dropped == 2 and got[i].text.split("\n")[1] == f"{i} {i + 1} {i + 2}"
