"""The command line from ingest to answers."""

import json

from sablefish import cli
from sablefish.plans import fixtures
from sablefish.sources import catalogs


def test_commands(spark, tmp_path, capsys):
    root, sx, store = tmp_path / "project", tmp_path / "sx", str(tmp_path / "store")
    root.mkdir()
    sx.mkdir()
    for name, text in fixtures.SOURCES.items():
        (root / name).write_bytes(text.encode("cp1252"))
    for name, text in fixtures.DICTIONARY.items():
        (sx / f"{name.upper()}.csv").write_text(text)

    def call(*argv):
        code = cli.main(["--store", store, "--format", "json", *argv], spark)
        out = capsys.readouterr().out
        return json.loads(out)["rows"] if code == 0 and out.startswith("{") else (code, out)

    assert call("callers", "x")[0] == 2
    assert {r["chave"]: r["n"] for r in call("ingest", str(root))}["arquivos"] == len(fixtures.SOURCES)
    assert {r["table_name"]: r["lost"] for r in call("ingest-sx", str(sx))}["consultas"] == 1
    assert [r["funcao"] for r in call("callers", "U_LOCMULTA")] == ["LOCROBO"]
    assert [r["tabela"] for r in call("tables", "sz6", "--mode", "write")] == ["SZ6", "SZ6"]
    assert {r["regra_id"] for r in call("lint", "--cross-file", "--severity", "error")} >= {"SX-002", "SX-010", "SX-011", "PERF-002"}
    assert call("lint", "--cross-file", "--rule", "SX-002") == call("lint", "--rule", "SX-002") != []
    assert len(call("impacto", "Z5_PLACA")) == 6 and len(call("gatilho", "Z6_XPLACA", "--depth", "1")) == 2
    assert call("execauto", "--op", "alt")[0]["routine"] == "MATA410" and call("workflow", "--kind", "schedule")[0]["target"] == "LOCREL"
    assert call("docs", "--module", "sigafat") == [] and len(call("docs")) == 1 and "# LOC020OK" in call("docs", "--show", "loc020ok")[1]
    assert call("status", "--check-stale", str(root)) == []
    assert {r["status"] for r in call("doctor")} == {"ok"} and call("version")[1].strip()
    assert [r["funcao"] for r in call("grep", "aviso AND multa", "--mode", "fts")] == [] and [r["funcao"] for r in call("grep", "\"reclock sz6\" NOT comentado", "--mode", "fts")] == ["LOCGRAVA"]
    assert [r["arquivo"] for r in call("sql", "locks")] == ["baixa_dupla.prw", "cliente_grava.prw"] and call("sql", "orphan-calls") == []
    assert {r["categoria"] for r in call("sql", "findings-with-rules")} >= {"BP", "SEC"} and call("sql", "SELECT count(*) AS n FROM fontes")[0]["n"] == len(fixtures.SOURCES)
    counts = call("sql", "index-counts")[0]
    assert counts["chunks"] == counts["indexed"] > 0
    (root / "legado.prw").write_text("User Function ZOLD()\nReturn\n")
    call("reindex", str(root), "LEGADO.prw")
    assert call("find", "zold")[0]["_kind"] == "funcao" and len(call("find", "LOCGRAVA")) == 1
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "_facts").rglob("*.parquet")}
    (root / "legado.prw").write_text("User Function ZNEW()\nReturn\n")
    import os

    os.utime(root / "legado.prw", (2_000_000_000, 2_000_000_000))
    assert [(r["arquivo"], r["status"]) for r in call("status", "--check-stale", str(root))] == [("legado.prw", "stale")]
    call("ingest", str(root), "--incremental")
    # only the changed source's rows were written, and nothing where nothing has changed
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "_facts").rglob("*.parquet")}
    assert before.items() <= after.items() and {r["arquivo"] for r in spark.read.parquet(*[str(p) for p in after.keys() - before.keys() if "/fonte_chunks/" in str(p)]).collect()} == {"legado.prw"}
    call("ingest", str(root), "--incremental")
    assert len(list((tmp_path / "store" / "_facts").rglob("*.parquet"))) == len(after)
    assert call("find", "znew")[0]["_kind"] == "funcao" and call("find", "StaticCall") == []
    assert call("status", "--check-stale", str(root)) == [] and len(call("find", "LOCGRAVA")) == 1


def test_catalogs(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"nome": "x", "tags": ["a"]}, {"nome": "y", "tags": []}]')
    (tmp_path / "b.json").write_text('[{"nome": "y", "tags": ["b"]}]')
    schema = "nome string, tags array<string>"
    both = catalogs.upsert(catalogs.read_catalog(spark, str(tmp_path / "a.json"), schema), catalogs.read_catalog(spark, str(tmp_path / "b.json"), schema), "nome")
    assert sorted((r["nome"], r["tags"]) for r in both.collect()) == [("x", ["a"]), ("y", ["b"])]
    import hashlib

    expected = hashlib.sha256((tmp_path / "a.json").read_bytes() + (tmp_path / "b.json").read_bytes()).hexdigest()
    assert catalogs.bundle_hash(spark, [str(tmp_path / "b.json"), str(tmp_path / "a.json")]).first()["bundle"] == expected
    assert catalogs.rules(spark).count() == 35 and catalogs.routines(spark).count() == 30 and catalogs.restricted(spark).count() > 190
