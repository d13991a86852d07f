import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions import vectors as V
from folioforge.functions.sentences import byte_spans, sentences, snap


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a\r\nb", "a\nb"),
        ("philo-\n  sophy", "philosophy"),
        ("foo-\n\nbar", "foobar"),
        ("IV. Of things\n\n12. Some\n\n§ 3. More\n\nNo. 5", "Of things\n\nSome\n\nMore\n\nNo. 5"),
        ("C. S. Lewis", "S. Lewis"),
        ("a  b\t\tc", "a b c"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("  x \n", "x"),
        ("", ""),
        (None, None),
    ],
)
def test_canonicalise(spark, raw, want):
    assert one(spark, raw, T.canonicalise) == want


def test_tokens(spark):
    got = one(spark, "The unexamined life isn't Worth", T.search_tokens)
    assert got == ["the", "unexamined", "life", "isn't", "worth", "the_unexamined", "unexamined_life", "life_isn't", "isn't_worth"]
    assert one(spark, "hēmin eph' e.g. x", T.search_words) == ["hēmin", "eph", "e.g", "x"]
    assert one(spark, "", T.search_tokens) == one(spark, "?!", T.search_tokens) == []
    assert one(spark, "Cogito, ergo -- SUM!", T.phrase_form) == "cogito ergo sum"
    assert one(spark, " Of  things,\n some ", T.folded) == "of things, some"
    assert one(spark, "a b c\n d", T.approx_tokens) == 4


@pytest.mark.parametrize("text", ["short", "x" * 200, "word " * 60, "y" * 300, "é" * 150, ("ab " * 66) + "日本語" * 10, "a" * 199 + "日 tail", "a" * 198 + "𝄞 tail"])
def test_excerpt(spark, text):
    data = text.encode()
    if len(data) <= 200:
        want = text
    else:
        end = 200
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        cut = data[:end].decode()
        want = (cut[: cut.rfind(" ")] if " " in cut else cut) + "…"
    assert one(spark, text, T.excerpt) == want


def test_cuts_and_markup(spark):
    assert one(spark, "Title\nmore", T.first_line) == "Title"
    assert one(spark, "a\nb", T.one_line) == "a b"
    assert one(spark, "abc def", lambda t: T.snippet(t, 4)) == "abc…"
    assert one(spark, "x<!DOCTYPE html PUBLIC 'a'>y<!DOCTYPE z>", T.strip_doctype) == "xy<!DOCTYPE z>"
    assert one(spark, "a&nbsp;b&mdash;&amp;&lt;&unknown;", T.resolve_entities) == "a b—&amp;&lt;&unknown;"
    assert one(spark, "aé日", lambda t: T.byte_slice(t, F.lit(1), F.lit(6))) == "é日"
    assert one(spark, "x", lambda t: T.render("{a}-{b}-{a}", a=F.lit("{b}"), b=t)) == "x-x-x"
    assert one(spark, "abc", T.content_hash) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mr. Smith said e.g. hello. Then he left.", ["Mr.", "Smith said e.g. hello.", "Then he left."]),
        ("One! Two? Three.", ["One!", "Two?", "Three."]),
        ("It is 3.5 now. U.S. law (yes.) Next", ["It is 3.5 now.", "U.S. law (yes.)", "Next"]),
        ("He waits… then goes — well; see § 5. End", ["He waits… then goes — well; see § 5.", "End"]),
        ("a.\nb", ["a.", "b"]),
        ("*** !!! Next one.", ["Next one."]),
        ("", []),
        ("   ", []),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences(text)] == want
    data = text.encode()
    assert [data[a:b].decode() for a, b in byte_spans(text)] == want


def test_snap():
    text = "Ätsch one here. Second sentence here. Third."
    data = text.encode()
    assert data[slice(*snap(text, 20, 24))].decode() == "Second sentence here."
    assert data[slice(*snap(text, 3, 20))].decode() == "Ätsch one here. Second sentence here."
    assert snap(text, 5, 5) is None and snap(text, 900, 990) is None
    assert snap("éé", 1, 3) == (0, 4)
    assert snap("!!é!!", 3, 5) == (2, 6)
    assert snap("!!——!!", 1, 6) == (1, 5) and snap("!!——!!", 3, 6) is None


def test_sentences_agree_with_icu(spark):
    """The ICU that Spark ships splits alike, segments without letters or digits aside."""
    jvm = spark.sparkContext._jvm
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["Dr. Who? No. 5 is alive. \"Yes.\" he said. (A.) B.C. 1.2.3 etc. and so on.\n\nNew", "Wait... what?! Ok.Then go. a.b c."]
    breaks = jvm.com.ibm.icu.text.BreakIterator
    for text in texts[:60] + texts[-2:]:
        it = breaks.getSentenceInstance(jvm.java.util.Locale.ROOT)
        it.setText(text)
        start, want = it.first(), []
        while (end := it.next()) != -1:
            part = text[start:end].strip()
            if any(c.isalnum() for c in part):
                want.append(part)
            start = end
        assert [text[a:b] for a, b in sentences(text)] == want


def test_vectors(spark):
    rows = [([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [r[0] for r in frame.select(V.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([1, 0, 0])
    assert frame.select(V.unit(F.col("a")).alias("u")).first().u == pytest.approx([0.6, 0.8])
    packed = frame.select("a", V.unpack_half(V.pack_half("a")).alias("u"), F.length(V.pack_half("a")).alias("n")).collect()
    assert all(np.allclose(r.a, r.u, atol=1e-3) and r.n == 4 for r in packed)
    s = spark.range(1).select(V.softmax3(F.lit(1000.0), F.lit(0.0), F.lit(-5.0)).alias("s")).first().s
    assert (s.entail, round(s.entail + s.neutral + s.contradict, 9)) == (1.0, 1.0)
    pooled = spark.createDataFrame([([1.0, 0.0, 9.0, 9.0, 0.0, 1.0], [1, 0, 1])], "t array<float>, m array<int>").select(V.mean_pool("t", "m").alias("v")).first().v
    assert pooled == pytest.approx([0.7071, 0.7071], abs=1e-4)


def test_embed(spark):
    texts = ["the cat sat", "the cat sat down", None, "", "other words entirely"] * 20
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", V.embed(F.col("t"), at_once=7).alias("v")).orderBy("id").collect()
    for r in rows:
        t = texts[r.id]
        assert (r.v is None) == (t is None)
        if t is not None:
            assert r.v == pytest.approx(V.hashed([t])[0])
            assert np.linalg.norm(r.v) == pytest.approx(1 if t else 0)
    near, far = (np.dot(rows[0].v, rows[k].v) for k in (1, 4))
    assert near > far


def test_few_rows_are_held_as_python_objects():
    import pyarrow as pa

    from folioforge.functions.binding import in_slices

    live, most = set(), []

    class Held(dict):
        def __init__(self, x):
            super().__init__(x=x)
            live.add(id(self))
            most.append(len(live))

        def __del__(self):
            live.discard(id(self))

    found = in_slices(lambda x: None if x is None else Held(x), pa.struct([("x", pa.int64())]), pa.array([*range(1000), None]), rows=10)
    assert found.to_pylist() == [*({"x": x} for x in range(1000)), None] and max(most) <= 30
    assert len(in_slices(Held, pa.struct([("x", pa.int64())]), pa.array([], pa.int64()))) == 0


def test_texts_without_sentences(spark, tmp_path):
    import duckdb

    from folioforge.plans import registry

    texts = ["One. Two!", "...", "", " \n", "12", "* * *\n?", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(f"SELECT doc_id, sentences, longest, last_end FROM ({registry.oracle_sql()['sentences']})").fetchall()
    rows = registry.queries()["sentences"](spark, str(tmp_path)).select("doc_id", "sentences", "longest", "last_end").collect()
    assert sorted(map(tuple, rows)) == sorted(found)
