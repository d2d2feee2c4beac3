"""Extraction on fixture sources."""

import pyarrow as pa
import pytest

from sablefish.operators import facts, lint
from sablefish.plans import fixtures


@pytest.fixture(scope="module")
def sources(spark):
    return fixtures.small_sources(spark).cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_functions_and_ranges(sources):
    found = rows(facts.functions(sources).where("arquivo = 'veiculo_mvc.prw'"), "nome", "linha_inicio", "linha_fim")
    assert found == [("FrotaLer", 12, 14), ("FrotaSalva", 15, 16), ("ModelDef", 4, 11)]


def test_verb_only_methods_are_named_after_their_class(sources):
    assert rows(facts.functions(sources).where("kind = 'ws_method'"), "nome") == [("Abrir",), ("Tarifas.DELETE",), ("Tarifas.GET",)]


def test_calls(sources):
    calls = facts.calls(sources)
    assert rows(calls.where("tipo = 'mvc_hook'"), "destino", "linha_origem") == [("bCommit", 8), ("bLoad", 7)]
    assert rows(calls.where("tipo = 'user_func'"), "funcao_origem", "destino_norm") == [("LOCROBO", "LOCMULTA")]
    assert rows(calls.where("tipo = 'execauto'"), "destino") == [("MATA410",)]


def test_tables_by_mode(sources):
    found = rows(facts.tables(sources).where("arquivo = 'cliente_grava.prw'"), "tabela", "modo")
    assert found == [("SZ6", "read"), ("SZ6", "reclock"), ("SZ6", "write")]


def test_parameters_merge_read_and_write(sources):
    assert rows(facts.parameters(sources), "parametro", "modo", "default_decl") == [("MV_LOCURL", "read_write", "https://loja")]


def test_endpoints(sources):
    assert rows(facts.endpoints(sources), "verbo", "path", "classe", "annotation_style") == [
        ("DELETE", "", "Tarifas", "wsmethod_restful"), ("DELETE", "/frota/:placa", "", "@verb_tlpp"), ("GET", "", "Tarifas", "wsmethod_restful"),
        ("GET", "/frota/livres", "", "@verb_tlpp"), ("PUT", "/frota/:placa", "", "@verb_tlpp"),
    ]


def test_sql_blocks(sources):
    found = rows(facts.sql_blocks(sources), "linha", "operacao", "tabelas")
    assert found == [(3, "select", []), (7, "select", ["SZ5990"]), (10, "delete", ["SZ6990"])]
    assert rows(facts.sql_blocks(sources, macros=True).where("linha = 3"), "tabelas") == [(["SZ5", "SZ6"],)]


def test_credentials_are_redacted(sources):
    assert "segredo" not in str(facts.http_calls(sources).collect()) + str(facts.chunks(sources).collect())


def test_summary(sources):
    found = {r["arquivo"]: r for r in facts.summaries(sources).collect()}
    assert found["veiculo_mvc.prw"]["source_type"] == "mvc"
    assert found["pe_devolucao.prw"]["pontos_entrada"] == ["LOC020OK"]
    assert found["robo_cobranca.prw"]["capabilities"] == ["ENV_OPENER", "JOB", "RPC"]
    assert found["frota_api.tlpp"]["namespace"] == "frota.publico"
    assert found["contratos_soap.prw"]["capabilities"] == ["WS-SOAP"]


def test_execauto_resolution(sources):
    row, other = facts.execauto_calls(sources).orderBy("linha").collect()
    assert other["dynamic_call"] and other["routine"] is None and other["tables_resolved"] == []
    assert (row["routine"], row["module"], row["op_code"], row["op_label"], row["arg_count"], row["dynamic_call"]) == ("MATA410", "SIGAFAT", 4, "alteracao", 3, False)
    assert row["tables_resolved"] == ["SC5", "SC6", "SF4", "SB1"]


def test_triggers(sources):
    found = {(r["kind"], r["target"]): r["metadata"] for r in facts.execution_triggers(sources).collect()}
    assert found["workflow", "LOCAP"]["return"] == "LocVolta" and found["workflow", "LOCAP"]["template"] == "/wf/aprova.htm" and found["workflow", "LOCAP"]["timeout"] == "LocTarde"
    assert found["schedule", "LOCREL"] == {"type": "P", "group": "LOCREL", "alias": "SZ6", "orders": "1, 3", "title": "Contratos"}
    assert found["job_standalone", "LOCROBO"]["sleep_seconds"] == "15" and found["job_standalone", "LOCROBO"]["stop_file"] == "parar.txt"
    assert found["mail_send", ""] == {"variant": "message", "attach": "true"}


def test_doc_block(sources):
    doc = facts.doc_blocks(sources).first()
    assert (doc["funcao"], doc["linha_bloco_inicio"], doc["linha_bloco_fim"], doc["linha_funcao"]) == ("LOC020OK", 1, 13, 14)
    assert doc["summary"] == "Confere a devolucao de um veiculo\nantes de fechar o contrato."
    assert [(p["name"], p["optional"], p["desc"]) for p in doc["params"]] == [("cPlaca", False, "placa do veiculo, sem traco"), ("nKm", True, "quilometragem lida")]
    assert doc["raw_tags"] == {"nota": "confere\nde novo"} and doc["module_inferido"] == "SIGALOJA"


def test_unreadable_source_is_a_row(spark):
    out = facts.scan_sources(spark.createDataFrame([("a.prw", "a.prw", None), ("b.prw", "b.prw", b"\x81\x8d")], "arquivo string, caminho_relativo string, content binary"))
    assert sorted((r["arquivo"], r["encoding"], r["error"]) for r in out.collect()) == [("a.prw", "cp1252", None), ("b.prw", "latin-1", None)]


LINT = {
    ("baixa_dupla.prw", "BP-001", 4), ("baixa_dupla.prw", "SEC-002", 1), ("veiculo_mvc.prw", "BP-007", 4), ("robo_cobranca.prw", "SEC-003", 11), ("robo_cobranca.prw", "SEC-004", 3),
    ("robo_cobranca.prw", "PERF-004", 5), ("robo_cobranca.prw", "MOD-001", 11), ("consultas.prw", "PERF-001", 7), ("consultas.prw", "PERF-002", 7), ("consultas.prw", "PERF-003", 10),
    ("legado.prw", "BP-002b", 2), ("legado.prw", "BP-005", 11), ("legado.prw", "BP-008", 4), ("legado.prw", "SEC-005", 6), ("legado.prw", "PERF-005", 5), ("legado.prw", "MOD-002", 3), ("legado.prw", "MOD-004", 7),
}


def test_restricted_functions_come_one_a_name_with_their_alternatives(sources):
    found = lint.lint_sources(sources, {"CriaVar": "a start value"}).where("regra_id = 'SEC-005'").collect()
    assert sorted((r["linha"], r["sugestao_fix"]) for r in found) == [
        (6, "Don't call a restricted function. (CRIAVAR) Use instead: a start value"), (6, "Don't call a restricted function. (STATICCALL)"),
    ]


def test_lint(sources):
    found = [(r["arquivo"], r["regra_id"], r["linha"]) for r in lint.lint_sources(sources).collect()]
    assert LINT <= set(found)
    assert sum(f[1] == "BP-001" for f in found) == 1
    assert ("pe_devolucao.prw", "BP-007", 14) not in found  # it is documented


@pytest.mark.parametrize(
    ("text", "rule", "lines"),
    [
        ("User Function A()\nBEGIN TRANSACTION\nReturn\n", "BP-002", [2]),
        ("User Function A()\nPergunte('X', .F.)\nx := MV_PAR01\nReturn\n", "BP-004", []),
        ("User Function A()\nPergunte('X', .F.)\nReturn\n", "BP-004", [2]),
        ("User Function A()\nRecLock('SA1', .T.)\nSA1->(dbAppend())\nMsUnlock()\nReturn\n", "BP-006", [1]),
        ("MsExecAuto({|x| MATA010(x)}, aItem, 3)\nReturn\n", "BP-003", [1]),
        ("User Function A() ; StaticCall(A, B) ; StaticCall(C, D)\nReturn\n", "SEC-005", [1]),
        ("User Function StaticCall()\nReturn StaticCall()\n", "SEC-005", []),
        ("CLASS X FROM WSRESTFUL\nRpcSetEnv('01')\nENDCLASS\nRpcSetEnv('02')\n", "SEC-001", [2]),
        ("User Function A()\n// RecLock('SA1')\nx := \"RecLock('SA1')\"\nReturn\n", "BP-001", []),
    ],
)
def test_single_rules(spark, text, rule, lines):
    src = facts.scan_sources(spark.createDataFrame([("a.prw", "a.prw", text.encode())], "arquivo string, caminho_relativo string, content binary"))
    assert sorted(r["linha"] for r in lint.lint_sources(src).where(f"regra_id = '{rule}'").collect()) == lines


def test_restricted_scans_find_what_full_ones_do(spark):
    files = spark.createDataFrame([(n, f"SIGALOJA/{n}", t.encode("cp1252")) for n, t in fixtures.TEMPLATES.items()], "arquivo string, caminho_relativo string, content binary")
    full = facts.scan_sources(files)
    for make, kinds in facts.KINDS.items():
        rows = [sorted(map(str, make(s).collect())) for s in (full, facts.scan_sources(files, kinds=kinds))]
        assert rows[0] == rows[1], make.__name__
        assert len({f.kind for r in facts.scan_sources(files, kinds=kinds).select("facts").collect() for f in r.facts} - kinds - facts.FUNCTION_KINDS) == 0


def test_sources_are_read_once_and_in_blocks(spark):
    files = spark.createDataFrame(fixtures.rows(), "arquivo string, caminho_relativo string, content binary")
    for make in (facts.endpoints, facts.execution_triggers):
        plan = make(facts.scan_sources(files))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1
    batch = pa.RecordBatch.from_pydict({"k": list(range(700)), "content": [b"x" * 10] * 600 + [None] + [b"y" * (3 << 20)] * 99})
    blocks = list(facts._blocks(iter([batch])))
    assert [k for b in blocks for k in b.column("k").to_pylist()] == list(range(700)) and max(b.num_rows for b in blocks) == facts.BLOCK_SOURCES and blocks[-1].num_rows == 1


def test_a_bare_endpoint_beside_a_classic_one(spark):
    text = "WSMETHOD GET Lista WSSERVICE Loja\nWSMETHOD GET WSSERVICE Loja\n"
    rows = facts.endpoints(facts.scan_sources(spark.createDataFrame([("a.prw", "a.prw", text.encode())], "arquivo string, caminho_relativo string, content binary"))).collect()
    assert sorted((r.classe, r.funcao, r.annotation_style, r.linha) for r in rows) == [("Loja", "", "wsmethod_restful", 2), ("Loja", "Lista", "wsmethod_classico", 1)]
