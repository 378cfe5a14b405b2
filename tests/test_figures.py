"""The figure search and the attachment of images on a small document."""

from folio.operators import answer


def test_three_passes_and_attachment(spark):
    images = spark.createDataFrame(
        [(1, 1, 0, "fig2", "Figure 2. x", 9), (1, 2, 0, "", "none", 0), (1, 2, 1, "", "none", 9), (1, 3, 0, "", "Figure 2", 9), (1, 4, 0, "Fig 7", "none", 9), (1, 6, 0, "", "Figure 9", 9)],
        "doc_id long, page long, img_pos long, label string, caption string, b64_len long",
    )
    mark = "[Visual Component] Caption: Figure "
    sections = spark.createDataFrame(
        [(1, 0, 1, 1, "text"), (1, 1, 5, 5, f"{mark}5\n"), (1, 2, 2, 3, f"a\n{mark}5\nb\n{mark}7"), (1, 3, 4, 4, ""), (1, 4, 3, 6, "")], "doc_id long, seq long, page_start long, page_end long, content string"
    )
    claims = spark.createDataFrame([(1, 3, 0, 2), (1, 4, 0, 3), (1, 6, 0, 4)], "doc_id long, page long, img_pos long, seq long")
    texts = ["figure 2", "fig. 7", "explain figure 5", "figure 8", "show the chart", "why", "figure 9"]
    questions = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "query_id long, doc_id long, query string")
    got = {r["query_id"]: tuple(r)[2:] for r in answer.resolved(questions, images, claims, sections).collect()}
    assert got == {0: (3, 0, 1), 1: (4, 0, 2), 2: (2, 1, 3), 6: (6, 0, 1)}
    found = spark.createDataFrame([(k, 1, s) for k in range(7) for s in (0, 2, 3)], "query_id long, doc_id long, seq long")
    got = {r["query_id"]: tuple(r)[2:] for r in answer.attached(questions, found, images, claims, sections).collect()}
    assert got == {0: (3, 0, 3), 1: (4, 0, 1), 2: (2, 1, 1), 4: (3, 0, 3), 6: (6, 0, 1)}
