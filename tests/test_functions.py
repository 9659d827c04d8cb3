"""Column functions: message codec (F-MESSAGE), path parts, text helpers."""


from sluice.functions import codec, paths, text


def _decode(spark, msgs):
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    d = df.select("m", codec.kv_decode("m").alias("d"))
    return {r["m"]: r for r in d.select("m", "d.ok", codec.kv_kinds("d").alias("kinds"),
                                        codec.kv_to_json("d").alias("json")).collect()}


def test_message_decoding_table(spark):
    r = _decode(spark, ["a:1,b:1.5,c:x", "a:-5", "a:1e5", "a:a.b", "a:1.2.3", "t:10:20:30", "a:",
                        "a:1,a:2", "novalue"])
    assert r["a:1,b:1.5,c:x"]["kinds"] == "a:int,b:float,c:str"
    assert r["a:1,b:1.5,c:x"]["json"] == '{"a":1,"b":1.5,"c":"x"}'
    assert r["a:-5"]["kinds"] == "a:str"          # E19: not isdigit
    assert r["a:1e5"]["kinds"] == "a:str"
    assert r["a:a.b"]["kinds"] == "a:str"         # reference raised; we keep text
    assert r["a:1.2.3"]["kinds"] == "a:str"
    assert r["t:10:20:30"]["json"] == '{"t":"10:20:30"}'   # E18: split at the first colon
    assert r["a:"]["json"] == '{"a":""}'
    assert r["a:1,a:2"]["json"] == '{"a":2}'      # last wins
    assert r["novalue"]["ok"] is False            # dead letter


def test_encode_decode_identity(spark):
    df = spark.createDataFrame([(1, "x y", 2.5), (22, "z", 0.25)], "a bigint, b string, c double")
    enc = df.select(codec.kv_encode("a", "b", "c").alias("m"))
    assert [r["m"] for r in enc.collect()] == ["a:1,b:x y,c:2.5", "a:22,b:z,c:0.25"]
    dec = enc.select(codec.kv_decode("m").alias("d")).select(
        codec.kv_get("d", "a", "int").alias("a"), codec.kv_get("d", "b").alias("b"),
        codec.kv_get("d", "c", "float").alias("c"))
    assert sorted(map(tuple, dec.collect())) == sorted(map(tuple, df.collect()))


def test_null_encodes_empty(spark):
    df = spark.createDataFrame([(None, "q")], "a string, b string")
    assert df.select(codec.kv_encode("a", "b").alias("m")).first()["m"] == "a:,b:q"


def test_path_parts_follow_python_suffix_rules(spark):
    import pathlib
    names = ["c.CSV", ".bashrc", "x.", "..a", "a.tar.gz", "noext", "dir/"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r["p"]: (r["pp"]["stem"], r["pp"]["extension"])
           for r in df.select("p", paths.path_parts("p").alias("pp")).collect()}
    for n in names[:-1]:
        p = pathlib.PurePosixPath(n)
        assert got[n] == (p.stem, p.suffix.lower()), n
    assert got["dir/"] == ("", "")


def test_url_tail_is_stripped(spark):
    df = spark.createDataFrame([("http://h.com/a/825.html?page=2#top",)], "u string")
    pp = df.select(paths.path_parts("u", url=True).alias("p")).first()["p"]
    assert (pp["file_name"], pp["stem"], pp["extension"]) == ("825.html", "825", ".html")


def test_streaming_hint_is_a_substring_match(spark):
    df = spark.createDataFrame([("/data/upstream/x.csv",), ("kafka://h/t",), ("/data/x.csv",)], "p string")
    got = [r[0] for r in df.select(paths.has_streaming_hint("p")).collect()]
    assert got == [True, True, False]   # E1: 'upstream' contains 'stream'


def test_modality_of_extension(spark):
    df = spark.createDataFrame([(e,) for e in [".csv", ".parquet", ".yml", ".png", ".txt", ""]], "e string")
    got = [r[0] for r in df.select(paths.modality_of_extension("e")).collect()]
    assert got == ["structured", "structured", "semi_structured", "unstructured", "unstructured", "unstructured"]


def test_text_helpers_match_python(spark):
    samples = ["  a b\tc \n", "x\n\ny", "", " \x0b "]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    rows = df.select("t", text.py_strip("t").alias("s"), text.word_count("t").alias("w")).collect()
    for r in rows:
        assert r["s"] == r["t"].strip(" \t\n\r\f\x0b")
        assert r["w"] == len(r["t"].split())


def plain_decode(msg):
    """Fields of a message, the last of a repeated key; None if an item has no colon."""
    items = [i.partition(":") for i in msg.split(",")]
    return None if any(not sep for _, sep, _ in items) else {k: v for k, _, v in items}


def test_decoder_against_plain_python(spark):
    msgs = ["a:1,b:1.5,c:x", "a:-5", "t:10:20:30", "a:", "a:1,a:2", "novalue", "", "x:1,y", "b:2,a:7.5,a:8", "a:1,b:2,a:3,b:4,a:5",
            ":v", ":v,:w", "a:1.5d,b:1.5f,c:1.5e3,d:.5,e:5.", "ab:1,b:2,ab:3", "a:b,b:a:1,a:b:2", "x.y:1,x.y:2,xzy:3"]
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    got = {r["m"]: r["d"] for r in codec.decode_messages(df, "m", "d").collect()}
    for m in msgs:
        assert got[m]["ok"] == (plain_decode(m) is not None) and got[m]["fields"] == plain_decode(m), m
    null = spark.createDataFrame([(None,)], "m string").select(codec.kv_decode("m").alias("d")).first()["d"]
    assert null["ok"] is None and null["fields"] is None


def test_numbers_have_no_type_suffix(spark):
    values = ["1.5d", "1.5f", "1.5", "-2.5", "+.5", "5.", "1.5e3", "1e5", "12", "-3", "1.2.3", ".", "9" * 30, "inf.", "٣"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: r["k"] for r in df.select("v", codec.value_kind("v").alias("k")).collect()}
    assert [v for v in values if got[v] == "float"] == ["1.5", "-2.5", "+.5", "5.", "1.5e3"]
    assert [v for v in values if got[v] == "int"] == ["12"]


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

def codec_kinds(spark, msg):
    df = spark.createDataFrame([(msg,)], "m string")
    return df.select(codec.kv_kinds(codec.kv_decode("m"))).first()[0]


_KEY = st.text(alphabet="abcdefghijklmnopqrstuvwxyz_", min_size=1, max_size=6)
_TEXT = st.text(alphabet=st.characters(blacklist_characters=",:.", blacklist_categories=("Cs",)),
                min_size=1, max_size=8)


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(_KEY, st.one_of(st.integers(min_value=0, max_value=10**12),
                                       st.floats(min_value=0.001, max_value=1e6, allow_nan=False).map(lambda f: round(f, 3)),
                                       _TEXT), min_size=1, max_size=5))
def test_encode_decode_identity_property(spark, fields):
    """encode -> decode gives back every value with its type (safe values:
    no separators inside; floats written with a dot)."""
    row = {}
    for k, v in fields.items():
        if isinstance(v, float) and float(v).is_integer():
            v = v + 0.5
        row[k] = v
    msg = ",".join(f"{k}:{v}" for k, v in row.items())
    df = spark.createDataFrame([(msg,)], "m string")
    d = codec.decode_messages(df, "m", "d").first()["d"]
    assert d["ok"]
    kinds = dict(x.rsplit(":", 1) for x in codec_kinds(spark, msg).split(","))
    got = {k: (v, kinds[k]) for k, v in d["fields"].items()}
    for k, v in row.items():
        text, kind = got[k]
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            exp_kind = "int" if str(v).isascii() and str(v).isdigit() else "str"
            assert (text, kind) == (str(v), exp_kind)
        elif isinstance(v, int):
            assert (int(text), kind) == (v, "int")
        else:
            assert (float(text), kind) == (v, "float")
