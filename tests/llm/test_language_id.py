import zlib

from quillcast.llm.language_id import declared_language, identify, train_text
from quillcast.llm.queries import op9_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op9_language_id(spark, sf).collect()
    docs = [r for r in rows if r.doc_id is not None]
    assert len(docs) == len(truth) and len(rows) - len(docs) == spark.read.parquet(f"{sf}/pages.parquet").count()
    held = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang == truth[r.doc_id] for r in held) / len(held) > 0.98
    pages = [r for r in rows if r.page_id is not None]
    assert sum(r.lang == r.declared for r in pages) / len(pages) > 0.98


def model(spark):
    en, fr = "the cat and the dog sat with that other thing", "le chat et la souris sont dans une maison avec eux"
    docs = spark.createDataFrame([(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(60)], "doc_id long, text string, lang string")
    return docs, *train_text(docs)


def test_witnesses_fuse(spark):
    docs, langs, table = model(spark)
    page = '<html lang="{}"><script>the the the the</script><p>{}</p></html>'
    fr, en = "le chat et la souris sont dans une maison", "the cat and the dog sat with that thing"
    rows = [(i, page.format("fr", fr), "http://www.site.fr/a") for i in range(40)] + [(100 + i, page.format("en", en), "http://blog.site.com/b") for i in range(40)]
    rows += [(900, "<p>ok</p>", "http://www.site.fr/c"), (901, "<p>ok</p>", "https://user@blog.site.com:80/d"), (902, "", "http://new.other.fr/"), (903, page.format("fr", en * 3), "http://blog.site.com/e")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string")
    got = {r.page_id: r for r in identify(pages, langs, table, "page_id", "html", "url").collect()}
    assert [got[i].lang for i in (900, 901, 902, 903)] == ["fr", "en", "fr", "en"]
    assert got[903].declared == "fr" and got[900].declared is None
    assert all(0 < r.confidence <= 1 for r in got.values())


def test_declared_language_is_found_wherever_it_stands():
    long = b"x" * 10_000
    html, meta = b"<html class='a' lang='fr-CA'>", b"""<meta http-equiv="Content-Language" content="de">"""
    for before in (b"", b"<!--%s-->" % long, b"<script>%s</script>" % long, b"<html><head><style>%s</style>" % long, b"<!-- <html lang='it'> -->", b"<script>'<html lang=it>'</script>"):
        assert declared_language(before + html) == "fr"
        assert declared_language(before + meta) == "de"
    assert declared_language(b"<!--" + html) is None and declared_language(b"<html>" + long) is None and declared_language(b"") is None
    assert declared_language(b"<meta " * 200_000) is None


def test_longer_texts_are_stronger_evidence(spark):
    docs, langs, table = model(spark)
    words = "the cat and the dog sat avec eux with that other thing in une maison "
    rows = [(n, words * n, "http://site.com/") for n in (4, 16, 64)]
    texts = spark.createDataFrame(rows, "id long, content string, url string")
    got = {r.id: r for r in identify(texts, langs, table, markup=False).collect()}
    assert {r.lang for r in got.values()} == {"en"}
    assert got[4].confidence <= got[16].confidence <= got[64].confidence


def test_odd_rows(spark):
    docs, langs, table = model(spark)
    rows = [(None, None, None, 1), (1, "", "", 1), (1, "", "", 1), (2, "the dog " * 50_000, "not an address", 1)]
    odd = spark.createDataFrame(rows, "id long, content string, url string, host int")
    got = identify(odd, langs, table).collect()
    assert sorted((str(r.id) for r in got)) == ["1", "1", "2", "None"] and {r.lang for r in got if r.id == 2} == {"en"}
    assert identify(odd.limit(0), langs, table).collect() == []
    none, empty = train_text(docs.limit(0))
    assert none == [] and {r.lang for r in identify(odd, none, empty).collect()} == {None}
