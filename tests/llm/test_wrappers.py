"""Template texts are counted exactly, however many texts share their slot."""

import pytest

from riskloom.llm import wrappers
from riskloom.llm.base import OWN


@pytest.mark.parametrize("held", [wrappers.HELD, 50])
def test_boilerplate_among_many_paragraphs(spark, monkeypatch, held):
    """Hosts of 3 and of 40 pages; 2, 8, 17 and 30 paragraphs beside the one that repeats."""
    monkeypatch.setattr(wrappers, "HELD", held)
    rows = []
    for host, pages, size in (("a", 40, 2), ("b", 40, 8), ("c", 40, 17), ("d", 40, 30), ("e", 3, 17), ("f", 3, 1), ("copies", 5, 20)):
        for k in range(pages):
            name = f"{host} {0 if host == 'copies' else k}"
            story = [f"<p>Story {name} part {i}</p>" for i in range(size)]
            rows.append((len(rows), f"http://{host}/{k}", f"<html><body><div>{''.join(story[:1])}<p>Always here</p>{''.join(story[1:])}</div></body></html>"))
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(5)
    for r in wrappers.main_text(pages).collect():
        lines = r[f"{OWN}text"].split("\n")
        assert ("Always here" in lines) == ("copies" in r["url"]), r["url"]
        assert sum(x.startswith("Story") for x in lines) == {"a": 2, "b": 8, "c": 17, "d": 30, "e": 17, "f": 1, "copies": 20}[r["url"].split("/")[2]]


def test_pages_of_any_depth():
    """5,000 elements inside each other: all their blocks stay, in page order, and no walk recurses that deep."""
    from riskloom.llm import wrappers

    page = "<body>" + "".join(f"<div>t{i}" for i in range(5000)) + "</div>" * 5000 + "<p>end</p></body>"
    root, blocks = wrappers.parse(page)
    assert [b[1] for b in blocks] == [f"t{i}" for i in range(5000)] + ["end"]
    tree = wrappers._wrap(root)
    assert wrappers.merge(tree, wrappers._wrap(wrappers.parse(page)[0]))[1] == 2
