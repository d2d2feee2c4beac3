"""Dictionary ingest, cross rules, commands, source scan and refresh."""

import pytest

from sablefish.operators import commands, facts
from sablefish.operators import relational as R
from sablefish.plans import extraction, fixtures
from sablefish.sources import dictionary, files
from sablefish.streaming import refresh


@pytest.fixture(scope="module")
def tables(spark):
    return fixtures.small_dictionary(spark)[0]


def test_files_give_the_same_tables(spark, tables, tmp_path):
    paths = {}
    for name, text in fixtures.DICTIONARY.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode("cp1252" if name == "sx3" else "utf-8"))
        paths[name] = str(tmp_path / f"{name}.csv")
    loaded, failed, lost = dictionary.load(spark, paths)
    assert not failed and {r["table_name"]: r["lost"] for r in lost.collect()}["consultas"] == 1
    for name, df in tables.items():
        assert sorted(map(str, loaded[name].collect())) == sorted(map(str, df.collect())), name


def test_wrong_shapes(spark, tmp_path):
    (tmp_path / "sxg.csv").write_text("A,B\n1,2\n")
    (tmp_path / "sx2.csv").write_bytes(b"PK\x03\x04zip")
    loaded, failed, _ = dictionary.load(spark, {"sxg": str(tmp_path / "sxg.csv"), "sx2": str(tmp_path / "sx2.csv")})
    assert not loaded and set(failed) == {"sxg", "sx2"}
    assert dictionary.find_files(["SX2.CSV", "sx3.csv"]) == {"sx2": "SX2.CSV", "sx3": "sx3.csv"}


def test_spreadsheet_in_place_of_a_csv(spark, tmp_path):
    import csv
    import io

    from sablefish.plans import derived

    paths = {}
    for name in ("sx2", "sx3", "sxg"):
        lines = list(csv.reader(io.StringIO(fixtures.DICTIONARY[name])))
        (tmp_path / f"{name}.csv").write_bytes(derived.workbook([tuple(v if k == 0 or not v.isdigit() or v[0] == "0" else int(v) for v in row) for k, row in enumerate(lines)]))
        (tmp_path / f"plain_{name}.csv").write_text(fixtures.DICTIONARY[name])
        paths[name] = str(tmp_path / f"{name}.csv")
    sheets, failed, _ = dictionary.load(spark, paths)
    plain, _, _ = dictionary.load(spark, {n: str(tmp_path / f"plain_{n}.csv") for n in paths})
    assert not failed and sheets.keys() == plain.keys()
    for name in plain:
        assert sorted(map(str, sheets[name].collect())) == sorted(map(str, plain[name].collect())), name


def test_typed_flags(tables):
    campos = {r["campo"]: r for r in tables["campos"].collect()}
    assert campos["Z5_XCHASSI"]["custom"] and not campos["Z5_PLACA"]["custom"] and campos["Z5_XPESO"]["obrigatorio"]
    assert campos["Z5_XCHASSI"]["inicializador"] == "Space(17)" and campos["Z5_PLACA"]["tamanho"] == 7
    assert sorted(r["codigo"] for r in tables["tabelas"].collect() if r["custom"]) == ["SZ5", "SZ6", "ZLX"]
    assert "SZ8" not in {r["codigo"] for r in tables["tabelas"].collect()}
    assert [r["total_campos"] for r in tables["grupos_campo"].collect()] == [2]


def test_cross_rules(spark):
    found = {(r["regra_id"], r["funcao"]) for r in extraction.cross_lint(spark, fixtures.small_sources(spark), fixtures.small_dictionary(spark)[0]).collect()}
    assert {
        ("SX-001", "Z5_XCHASSI"), ("SX-002", "Z6_XPLACA#02"), ("SX-003", "MV_LOCDIA"), ("SX-004", "LOCSEM"), ("SX-005", "Z5_XNUNCA"), ("SX-006", "Z6_XPLACA"), ("SX-007", "Z5_XPESO"),
        ("SX-008", "Z5_ANO"), ("SX-009", "Z5_XPESO"), ("SX-010", "Z6_XPLACA#02"), ("SX-010", "Z6_NUM#01"), ("SX-011", "Z5_XPESO"), ("MOD-003", ""), ("PERF-006", "LOCBUSCA"),
    } <= found
    assert ("SX-003", "MV_LOCURL") not in found and ("SX-005", "Z6_XPLACA") not in found


def test_rules_without_a_dictionary_are_skipped(spark):
    from sablefish.operators import lint

    made = {"functions": facts.functions(fixtures.small_sources(spark))}
    assert {r["regra_id"] for r in lint.cross_rules({}, made, None).collect()} == {"MOD-003"}


def test_impact_and_cascade(spark, tables):
    chunks = facts.chunks(fixtures.small_sources(spark))
    found = [tuple(r)[:2] for r in commands.impact(chunks, tables["campos"], tables["gatilhos"], tables["perguntas"], "Z5_PLACA").collect()]
    assert found == [("SX7", "Z5_ANO#01"), ("SX7", "Z6_NUM#01"), ("SX7", "Z6_XPLACA#01"), ("SX7", "Z6_XPLACA#02"), ("SX3", "SZ5.Z5_PLACA"), ("fonte", "consultas.prw::LOCBUSCA")]
    one = [(r["nivel"], r["origem"], r["destino"]) for r in commands.trigger_cascade(tables["gatilhos"], "z6_xplaca", 1).collect()]
    assert sorted(one) == [(1, "Z6_XPLACA", "Z6_NUM"), (1, "Z6_XPLACA", "Z6_PERDIDO")]


def test_commands(spark):
    src = fixtures.small_sources(spark)
    chunks, calls, found = facts.chunks(src), facts.calls(src), facts.execauto_calls(src)
    listing = src.select("arquivo", "caminho_relativo", "encoding", "error")
    assert [r["_kind"] for r in commands.find(chunks, listing, "U_LOCGRAVA").collect()] == ["funcao"]
    assert [r["arquivo"] for r in commands.find(chunks, listing, "lo_mvc").collect()] == ["veiculo_mvc.prw"]
    assert [r["_kind"] for r in commands.find(chunks, listing, "gerente@loja").collect()] == ["texto"]
    assert [(r["funcao"], r["is_self_call"]) for r in commands.callers(calls, "locmulta").collect()] == [("LOCROBO", False)]
    assert [r["destino"] for r in commands.callees(calls, "PEDIDO_AUTO.PRW").collect()] == ["MATA410"]
    assert commands.execautos(found, op="alt").count() == 1 and commands.execautos(found, op="nope").count() == 0
    assert commands.triggers(facts.execution_triggers(src), "nope").count() == 0
    assert [r["tables_via_execauto"] for r in commands.arch(facts.summaries(src), found, "PEDIDO_AUTO.prw").collect()] == [["SB1", "SC5", "SC6", "SF4"]]
    assert [r["status"] for r in commands.doctor(listing, chunks).collect()] == ["ok", "ok", "ok"]
    assert commands.grep(chunks, "reclock(", "literal").count() == 2 and sorted(r["funcao"] for r in commands.grep(chunks, "U_LOCMULTA", "identifier").collect()) == ["LOCMULTA", "LOCMULTAS", "LOCROBO"]
    assert "[RecLock" in commands.grep(chunks, "reclock NOT comentado", "fts").first()["snippet"]


def test_scan_and_refresh(spark, tmp_path):
    root = tmp_path / "project"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    for name, text in {"a.prw": "User Function A()\nReturn\n", "B.PRW": "User Function B()\n", "sub/A.prw": "User Function A2()\n", "c.prw.bak": "x", "empty.prw": "", ".git/d.prw": "x", "e.txt": "x"}.items():
        (root / name).write_text(text)
    found = files.scan(spark, str(root))
    assert sorted(r["arquivo"] for r in found.select("arquivo").collect()) == ["B.PRW", "a.prw"]
    assert sorted(r["caminho_relativo"] for r in found.select("caminho_relativo").collect()) == ["B.PRW", "a.prw"]
    stored = refresh.build(facts.scan_sources(found))
    stored = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in stored.items()}
    known = spark.createDataFrame(found.select("arquivo", "mtime_ns").collect(), "arquivo string, mtime_ns long")
    (root / "a.prw").write_text("User Function A3()\nReturn\n")
    import os

    os.utime(root / "a.prw", (2_000_000_000, 2_000_000_000))
    again = files.changed(files.scan(spark, str(root)), known)
    out = refresh.refresh(stored, facts.scan_sources(again))
    assert sorted(r["funcao"] for r in out["fonte_chunks"].collect()) == ["A3", "B"]
    assert R.purge(out["fonte_chunks"], found.where("arquivo = 'B.PRW'"), "arquivo").count() == 1


def test_stream(spark, tmp_path):
    """Batches replace their own sources only."""
    root = tmp_path / "in"
    root.mkdir()

    def run(name, text):
        (root / name).write_text(text)
        q = refresh.stream(spark, str(root), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(120)
        words = {r["token"] for r in refresh.load(spark, str(tmp_path / "out"), "palavras").select("token").collect()}
        out = sorted(r["funcao"] for r in refresh.load(spark, str(tmp_path / "out"), "fonte_chunks").collect())
        assert words == {*(x.lower() for x in out), "user", "function", "return"}
        return out

    assert run("a.prw", "User Function A()\nReturn\n") == ["A"]
    assert run("b.prw", "User Function B()\nReturn\n") == ["A", "B"]
    (root / "sub").mkdir()
    assert run("sub/a.prw", "User Function A2()\nReturn\n") == ["A2", "B"]


def test_paths_are_relative_to_the_folder_given(spark, tmp_path):
    root = tmp_path / "src" / ".git" / "app" / "src"
    (root / "x" / "node_modules").mkdir(parents=True)
    (root / "x" / "A.PRW").write_text("User Function A()\n")
    (root / "x" / "node_modules" / "b.prw").write_text("x")
    assert [r["caminho_relativo"] for r in files.scan(spark, str(root) + "/").collect()] == ["x/A.PRW"]


def test_names_inside_longer_words(spark):
    from sablefish.operators import lint

    campos = spark.createDataFrame([("SZ5", c, c, True) for c in ("Z5_XA", "Z5_XB", "Z5_XLONGER", "AB")], "tabela string, campo string, titulo string, custom boolean")
    campos = campos.selectExpr("*", "'' AS validacao", "'' AS vlduser", "'' AS when_expr", "'' AS inicializador")
    chunks = spark.createDataFrame([("M->z5_xa + 1",), ("cZ5_XLONGERNAME",), ("xABx",)], "content string")
    none = spark.createDataFrame([], "regra string, condicao string, chave string")
    assert [r["funcao"] for r in lint.sx005(campos, chunks, none).collect()] == ["Z5_XB"]


@pytest.mark.parametrize("most_bytes", [None, 150])
def test_needles_inside_texts(spark, most_bytes):
    from sablefish.operators import multipattern

    texts = ["one two three four five six", "xone two threex", "", None, "alone", "tab\ttwo three four", "two  blanks here now", "aaaa", "漢字 été", "long " * 3000 + "end"]
    needles = ["two three four five", "one two three", "ne two th", "lon", "two three", "tab\ttwo three", "four  five", "six one", "o  blanks he", " ", "two three four five six", None, "aa", "aaa", "字 é", "g end", "lon"]
    a = spark.createDataFrame(list(enumerate(needles)), "k int, needle string").repartition(3)
    b = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r["k"] for r in multipattern.found_inside(a, "k", "needle", b, "t", most_bytes).collect()}
    assert got == {k for k, n in enumerate(needles) if n is not None and any(n in (t or "") for t in texts)}
    places = {(r["i"], r["needle"]): r["places"] for r in multipattern.occurrences(a, "needle", b, "t", most_bytes).collect()}
    wanted = {(i, n): [p + 1 for p in range(len(t)) if t.startswith(n, p)] for i, t in enumerate(texts) for n in needles if n and t is not None and n in t}
    assert places == wanted
    none = a.where("false")
    assert multipattern.found_inside(none, "k", "needle", b, "t").count() == multipattern.occurrences(none, "needle", b, "t").count() == 0
    everywhere = spark.createDataFrame([(1, "")], "k int, needle string")
    assert multipattern.found_inside(everywhere, "k", "needle", b, "t").count() == 1 and multipattern.occurrences(everywhere, "needle", b, "t").count() == 9
