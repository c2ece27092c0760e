"""One line over and over is junk, however long the line is."""

from landreach.llm import quality


def test_repeated_lines_of_any_length(spark):
    long = "WARNING: " + " ".join(f"the value of item {i} is not what it was" for i in range(11))
    assert len(long) > 400
    told = "The cat sat on the mat.\nThen it left.\nThe cat sat on the mat.\nIt came back.\n"
    texts = [
        "\n".join([long] * 20), "\n".join(["nan"] * 60), "\n".join(["..."] * 60), "Disk is nearly full now.\r\n" * 30, "Disk is nearly full now.\n\n" * 30,
        "  Disk is nearly full now.\nDisk is nearly full now. \n" * 20, told * 5, "a line that comes twice\na line that comes twice\nanother", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.repeat_share for r in quality.statistics(df).collect()}
    assert got == {i: float(i < 6) for i in range(len(texts))}  # whatever their length and line ends
    kinds = {r.doc_id: r.kind for r in quality.kinds(df).collect()}
    assert [kinds.get(i) for i in range(7)] == ["junk"] * 6 + [None]
