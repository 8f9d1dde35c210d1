from collections import Counter

from pyspark.sql import functions as F

from textwarden.llm import line_dedup


def slow(rows, ratio, least):
    pages, lines = Counter(), Counter()
    for host, text in rows:
        pages[host] += 1
        lines.update({(host, x.strip(" ")) for x in (text or "").split("\n") if x.strip(" ")})
    out = []
    for host, text in rows:
        if text is None:
            out.append((host, None, 0))
            continue
        gone = lambda x: lines[host, x.strip(" ")] >= least and lines[host, x.strip(" ")] > ratio * pages[host]
        kept = [x for x in text.split("\n") if not gone(x)]
        out.append((host, "\n".join(kept), len(text.split("\n")) - len(kept)))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def test_against_brute_force(docs_of, odd_rows):
    rows = [(i, f"menu\n  {i} body \n\n{'rare' if i % 9 == 0 else i}\nfoot ", "en", "a" if i % 2 else None) for i in range(40)]
    rows += [(100 + i, "menu\nall of it\nmenu", "en", "b") for i in range(6)] + odd_rows
    docs = docs_of(rows)
    found = line_dedup.drop_frequent(docs, "source", "text", ratio=0.3, min_pages=5)
    assert found.columns == [*docs.columns, "_lines_removed"]
    got = sorted(((r["source"], r["text"], r["_lines_removed"]) for r in found.collect()), key=key)
    assert got == sorted(slow([(r[3], r[1]) for r in rows], 0.3, 5), key=key)
    assert any(n for _, _, n in got) and ("b", "", 3) in got


def test_small_sites_keep_their_lines(docs_of):
    docs = docs_of([(1, "only\npage", None, "a")])
    assert line_dedup.drop_frequent(docs, "source", "text").first()["text"] == "only\npage"


def test_copies_of_a_text_are_one_page_in_the_pipeline(docs_of):
    import corpus_pipeline

    copy = "menu\none two three\nfour five six"
    rows = [(i, copy, "en", "a") for i in range(40)]
    rows += [(100 + i, f"menu\nown text {i}", "en", "a") for i in range(30)]
    found = {r["doc_id"]: r for r in corpus_pipeline.drop_boilerplate(None, docs_of(rows), "").collect()}
    assert len(found) == len(rows)
    assert {found[i]["text"] for i in range(40)} == {"one two three\nfour five six"}
    assert all(found[100 + i]["text"] == f"own text {i}" for i in range(30))
    # in the query, whose pages are what they are, copies count
    assert line_dedup.drop_frequent(docs_of(rows), "source", "text").where("doc_id = 0").first()["text"] == ""


def test_empty_table_and_clashing_column(docs_of):
    docs = docs_of([]).withColumn("_lines_removed", F.lit("x")).withColumn("line", F.lit(1))
    found = line_dedup.drop_frequent(docs, "source", "text")
    assert found.count() == 0 and found.columns.count("_lines_removed") == 1


def test_hosts_and_lines_of_pages(spark):
    urls = ["HTTP://u@A.org:80/x", "nothing", None, "https://b.net?q", "https:///x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(line_dedup.host_of(F.col("url"))).collect()] == ["a.org", None, None, "b.net", None]
    html = "<html><script>var t='</p>';</script ><p>one <b>two</b>\n</p>\n\n<STYLE a>x</STYLE>three"
    df = spark.createDataFrame([(html,), (None,)], "h string")
    lines = [r[0] for r in df.select(line_dedup.html_lines(F.col("h"))).collect()]
    assert [x for x in lines[0].split("\n") if x.strip()] == ["one", "two", "three"] and lines[1] is None
