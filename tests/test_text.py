"""Text helpers."""

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sablefish.functions import charset, personal, scanner, sql_names
from sablefish.functions import source_text as T
from sablefish.operators import facts
from sablefish.plans import derived
from sablefish.sources import spreadsheet

CODE = st.text(alphabet="ab \n\t/*&'\"\\();,é", max_size=80)


@given(CODE)
@settings(max_examples=300, deadline=None)
def test_blank_keeps_places(text):
    for strings in (True, False):
        out = T.blank(text, strings)
        assert len(out) == len(text)
        assert [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


@given(st.text(alphabet="ab \n/\"'\\", max_size=60))
@settings(max_examples=200, deadline=None)
def test_blank_twice(text):
    # without line comments that need to be first on their line: a blanked string before one makes it first
    once = T.blank(text)
    assert T.blank(once) == once


def test_blank_cases():
    assert T.blank('a := "x" // y') == "a :=         "
    assert T.blank("*--- U_A()\nU_B()") == "          \nU_B()"
    assert T.blank("n := 2 * 3") == "n := 2 * 3"
    assert T.blank("&& U_A()\n&cMacro") == "        \n&cMacro"
    assert T.blank("f('SA1')", strings=False) == "f('SA1')"


def test_arguments():
    assert T.split_arguments('a, f(b, c), {1, 2}, "x, y"') == ["a", "f(b, c)", "{1, 2}", '"x, y"']
    assert T.split_arguments("a, b, c, d", most=2) == ["a", "b, c, d"]
    assert T.call_arguments('f(a, ")", (b))x', 2) == ('a, ")", (b)', 13)
    assert T.call_arguments("f(a", 2) is None
    assert T.literal("'x'") == "x" and T.literal("x") == ""


def test_decode():
    assert T.decode(b"") == ("", "cp1252")
    assert T.decode("ação".encode()) == ("ação", "utf-8")
    assert T.decode("ação".encode("cp1252")) == ("ação", "cp1252")
    assert T.decode(b"\x81")[1] == "latin-1"


def test_loops():
    assert list(T.loops("While a\nFor b\nNext\nEndDo\n")) == [(2, 3), (1, 4)]


def kinds(text):
    return [(o["kind"], o["line"], o["g"]) for o in facts.occurrences(text)[2]]


def test_tokens_know_comments_strings_and_places():
    text = "x := 'it''s' + \"a // b\" // c\n* gone\n  && gone too\ny->z /* two\nlines */ .T. 1.5 a::b\n'open"
    t = scanner.scan(text)
    assert t.text == ["x", ":=", "'it'", "'s'", "+", '"a // b"', "y", "->", "z", ".T.", "1", ".", "5", "a", "::", "b", "'open"]
    assert all(text[a:b] == w for a, b, w in zip(t.start, t.stop, t.text, strict=True))
    assert t.line == [1] * 6 + [4] * 3 + [5] * 7 + [6] and [w for w, f in zip(t.text, t.first, strict=True) if f] == ["x", "y", "'open"]
    assert scanner.scan("").text == [] and scanner.scan("\\'a").text == ["\\", "'a"]


def test_rules_over_tokens():
    assert ("function", 2, ["User", "Foo"]) in kinds("\n  User  Function Foo(a, b)\n") and ("signature", 1, ["F", "a, ;\n b"]) in kinds("Function F(a, ;\n b)\n")
    assert [k for k in kinds("x Function F()\n") if k[0] == "function"] == []
    assert ("ws_method", 1, ["", "GET"]) in kinds("WSMETHOD GET WSSERVICE Clientes\n") and ("rest_bare", 1, ["GET", "Clientes"]) in kinds("WSMETHOD GET WSSERVICE Clientes\n")
    assert ("param_read", 1, ["MV_X", "", "d"]) in kinds("GetMv('MV_X', .F., 'd')") and ("param_read", 1, ["MV_X", "d", ""]) in kinds("GetMv('MV_X', 'd')") and ("param_read", 1, ["MV_X", "", ""]) in kinds("GetMv('MV_X')")
    # calls given as text count, comments don't
    assert ("table_read", 1, ["SA1"]) in kinds("&(\"DbSelectArea('SA1')\")") and not any(k[0] == "table_read" for k in kinds("// DbSelectArea('SA1')\n"))
    assert [k[2] for k in kinds("o:New():Run( ) ; ::Go()") if k[0] == "call_method"] == [["o:New"], ["::Go"]]
    assert [k for k in kinds("cA := cA + 'x'\ncB += 1\ncC := cD + 1\nnE += 2") if k[0] == "concat"] == [("concat", 1, ["cA", ""]), ("concat", 2, ["cB"])]
    assert ("sql", 1, [" SELECT 'x' FROM %table:SA1% "]) in kinds("BeginSql Alias 'Q' SELECT 'x' FROM %table:SA1% EndSql")
    assert ("doc", 1, [" Foo".strip(), "\nsays\n"]) in kinds("/*/{Protheus.doc} Foo\nsays\n/*/\nUser Function Foo()\n") and [k[0] for k in kinds("/*/{Protheus.doc} X\nnever closed")] == ["doc_open"]
    assert ("count_check", 1, []) in kinds("If (RecCount()) > 0") and ("job_sleep", 1, ["5", "1000"]) in kinds("Sleep(5 * 1000)") and ("paramixb", 1, []) in kinds("x := PARAMIXB[1]")
    assert [k for k in kinds("If RecCount() > 05") if k[0] == "count_check"] == []


def test_personal_data():
    for text, found in {
        "cCpf": True, "cCPF": False, "Senha1": True, "nTokenX": True, "cPass": True, "cPassX": True, "cPassage": False, "xPass": False, "SA1->A1_CGC": True, "A1_CGCX": False, "'cCpf'": False, "'123.456.789-01'": True,
        "'12.345.678/0001-90'": True, "'1123.456.789-01'": False, "'x 123.456.789-01.'": True, "'123-456'": False, "": False,
    }.items():
        assert personal.names_a_person(text) == found, text


def test_tables_of_statements():
    for sql, names in {
        "select * from a": ["A"], "SELECT 1": [], "": [], "from": [], "SELECT * FROM (SELECT * FROM x) y, z AS w, v": ["V", "X", "Z"], "select 'from a' from b -- from c": ["B"],
        "with q as (select * from r) select * from q join Q2 on 1=1": ["Q2", "R"], "with recursive q (n) as (select 1 union all select n from q) select n from q": [],
        "insert into a.b (c) values (1)": ["B"], "delete from t": ["T"], "update only t set x = y": ["T"], "select trim(both ' ' from n) from t": ["T"], "truncate table t": ["T"], "drop table \"My T\"": ["MY T"],
        "select * from %table:SA1% SA1 where x in (select y from %Table: SB1%)": ["%SA1", "%SB1"], "select * from f(1) g, h": ["H"], "merge into t using (select * from s) x on t.k = x.k when matched then update set a = 1": ["S", "T"],
        "select * from a where b = 'it''s from c'": ["A"], "select * from [a b].[c]": ["C"], "select * from 'x": [],
    }.items():
        assert sql_names.tables(sql) == names, sql


def test_spreadsheets():
    rows = [("H1", "H2", "H3"), ("a & b", None, 3), ("é<", "x", 2.5), (None, "only", 10**9)]
    assert list(spreadsheet.sheet_rows(derived.workbook(rows))) == [["H1", "H2", "H3"], ["a & b", "", "3"], ["é<", "x", "2.5"], ["", "only", "1000000000"]]
    assert [spreadsheet.column_of(r) for r in ("A1", "Z9", "AA1", "BC12")] == [0, 25, 26, 54]


def test_charset_of_held_out_texts():
    words = "ação coração informação São João não é difícil café über straße größe mañana año señor été château".split()
    found = Counter()
    for w in words[::2]:
        found.update(charset.counts(f"uma {w} com texto"))
    model = charset.Model(found)
    for page in ("cp1252", "cp850"):
        assert sum(model.detect(f"outra {w} aqui, {w}.".encode(page)) == page for w in words[1::2]) >= len(words[1::2]) - 1
    assert model.detect(b"plain") == "cp1252" and model.detect("é".encode()) == "utf-8" and model.detect(b"") == "cp1252"
    assert T.decode("São João".encode("cp850"), model.detect) == ("São João", "cp850")


def test_charset_of_short_texts():
    found = Counter()
    for text in ["Öl für schöne Größe, Öfen aus Äpfeln über Flüsse"] * 20 + ["Índice del niño, así dice él, aquí está el camino en Ítaca"] * 8:
        found.update(charset.counts(text))
    model = charset.Model(found)
    # cp850's Í is cp1252's Ö, which is more frequent: what stands beside it tells them apart
    assert model.detect("Índigo".encode("cp850")) == "cp850" and model.detect("Öle".encode("cp1252")) == "cp1252"
    # bytes of a code page that happen to be valid UTF-8, of a character that no text had; and an unknown script
    raw = "schßöü".encode("cp850")
    assert len(raw.decode("utf-8")) == 4 and model.detect(raw) == "cp850"
    assert model.detect("漢字".encode()) == "utf-8" and model.detect("über".encode()) == "utf-8"


def test_encoded_texts_keep_a_letter_beyond_ascii():
    assert derived._bytes("für 漢字", "cp850") == "für éé".encode("cp850") and derived._bytes("— ok", "cp850") == "é ok".encode("cp850") and derived._bytes("€", "cp1252") == b"\x80"


def test_statements_are_dealt_out_to_all_cores(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = derived.sql_table_names(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert made == spark.sparkContext.defaultParallelism
