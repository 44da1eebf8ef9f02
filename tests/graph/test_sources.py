import json

import pytest

from graphloom import cli
from graphloom.plans import profile, tools
from graphloom.plans.build import build
from graphloom.sources import walk
from graphloom.sources.extract import SPECS, extract
from graphloom.sources.store import Graph

SOLIDITY = """
contract Base { function helper() internal {} }
contract Bank is Base {
    mapping(address => uint) public balances;
    address owner;
    enum State { Open, Closed }
    State public state;
    event Paid(address to);
    modifier onlyOwner() { require(msg.sender == owner); _; }
    function withdraw(uint amount) external { // transfer( in a comment
        msg.sender.call{value: amount}("");
        balances[msg.sender] -= amount;
        emit Paid(msg.sender);
    }
    function close() public onlyOwner { require(state == State.Open); state = State.Closed; }
    function total() public view returns (uint) { return balances[owner]; }
}
"""
CODE = {
    "vyper": ("v.vy", "owner: address\n\n@external\ndef pay(to: address):\n    self.owner = to\n    send(to, 1)\n", "pay", "owner"),
    "move": ("m.move", "module a::bank {\n  struct Vault has key { v: u64 }\n  public entry fun put(x: u64) { move_to<Vault>(x); transfer(x); }\n}", "put", "Vault"),
    "clarity": ("c.clar", "(define-data-var total uint u0)\n(define-public (add (n uint))\n  (begin (var-set total n) (stx-transfer? n tx-sender tx-sender)))\n", "add", "total"),
    "go": ("k.go", "package k\ntype Keeper struct {\n\tcount int\n}\nfunc (k *Keeper) Set(n int) {\n\tk.count = n\n\tv, _ := load(n)\n}\n", "Set", "count"),
    "java": ("S.java", "public class S {\n  private int n;\n  public void set(String x) {\n    this.n = 1;\n    Runtime.getRuntime().exec(x);\n    try { f(); } catch (Exception e) { }\n  }\n}", "set", "n"),
    "rust": ("r.rs", "pub struct A {\n    n: u64,\n}\nimpl A {\n    pub fn set(&mut self, x: u64) { self.n = x; unsafe { transmute(x) }; x.unwrap() }\n}\n", "set", "n"),
    "python": ("p.py", "import os\nclass A:\n    def run(self, cmd):\n        os.system(cmd)\n        self.go()\n    def go(self):\n        pass\n", "run", None),
    "typescript": ("t.ts", "export class W {\n  private key: string;\n  run() {}\n}\nexport function send(pk: string) { this.key = pk; JSON.parse(pk); sendTransaction(pk); }", "send", "key"),
    "proto": ("a.proto", "service Auth {\n  rpc Login (Req) returns (stream Res);\n}\n", "Login", None),
    "cpp": ("b.c", "int total;\nint copy(char *s) {\n  char b[8];\n  strcpy(b, s);\n  char *p = malloc(4);\n  *p = 1;\n  free(p);\n  free(p);\n  total = 1;\n  return 0;\n}\n", "copy", "total"),
}


def test_solidity():
    nodes, edges, moves = extract("src/Bank.sol", SOLIDITY, "solidity")
    by = {n["label"]: n for n in nodes if n["type"] == "function"}
    has = {(e["source"].split("::")[-1], e["target"].split("::")[-1], e["relation"]) for e in edges}
    assert json.loads(by["withdraw"]["metadata"])["reentrancy_risk"] and by["withdraw"]["id"] == "src/Bank.sol::Bank.withdraw(uint)"
    assert "reentrancy_risk" not in json.loads(by["close"]["metadata"]) and by["close"]["visibility"] == "public" and json.loads(by["total"]["metadata"])["view"]
    assert {("Bank", "Base", "inherits"), ("Bank.onlyOwner", "Bank.close()", "guards"), ("Bank.withdraw(uint)", "Bank.balances", "writes_state"), ("Bank.total()", "Bank.balances", "reads_state"), ("Bank.withdraw(uint)", "Paid", "emits_event")} <= has
    assert ("Bank.total()", "Bank.balances", "writes_state") not in has
    assert [(m["from_state"], m["to_state"], m["conditions"]) for m in moves] == [("Open", "Closed", '["onlyOwner"]')]
    assert any(json.loads(n["metadata"]).get("is_sink") for n in nodes)


@pytest.mark.parametrize("lang", CODE)
def test_languages(lang):
    path, source, function, variable = CODE[lang]
    nodes, edges, _ = extract(path, source, lang)
    found = {n["label"]: n for n in nodes}
    assert found[function]["type"] == "function"
    if variable:
        assert found[variable]["type"] == "state_var"
        assert any(e["relation"] == "writes_state" and e["target"] == found[variable]["id"] for e in edges)
    wanted = {"go": "unchecked_errors", "java": "injection_sinks", "rust": "panic_paths", "python": "command_injection_risk", "typescript": "deserialization_sinks", "proto": "auth_boundary", "cpp": "double_free_risk", "clarity": "transfer_sinks", "move": "move_entry"}
    if lang in wanted:
        assert wanted[lang] in json.loads(found[function]["metadata"])


def test_all_languages_take_any_text():
    for lang in SPECS:
        for text in ("", "{", "}}}((", "function f(", "\x00 \n" * 50, "def f(:\n", "fn fn fn(", '"' * 99):
            extract("x", text, lang)


def test_classification(spark):
    paths = {
        "src/Vault.sol": ("", "production", "solidity"), "test/Vault.sol": ("ignored_dir:test", "production", "solidity"), "script/Go.s.sol": ("ignored_dir:script", "script", "solidity"), "src/Go.s.sol": ("foundry_test_or_script", "script", "solidity"),
        "src/Vault.t.sol": ("foundry_test_or_script", "production", "solidity"), "a/x_test.go": ("test_file", "production", "go"), "a/x.pb.go": ("generated_file", "production", "go"), "a/deploy-all.ts": ("research_file:script", "script", "typescript"),
        "a/vite.config.ts": ("tool_config", "production", "typescript"), "hardhat.config.ts": ("", "production", "typescript"), "a/readme.md": ("unsupported_extension", "production", "generic"), "a/stdlib.fc": ("library_file", "production", "ton"),
        "fuzzing/A.sol": ("ignored_dir:fuzzing", "fuzz", "solidity"), "a/MyMockToken.sol": ("test_file", "production", "solidity"), "docs/static/a.js": ("docs_frontend", "production", "typescript"), "my-test-utils/a.go": ("ignored_dir:my-test-utils", "production", "go"),
    }
    df = spark.createDataFrame([(x,) for x in paths], "path string")
    got = df.select("path", walk.noise("path"), walk.source_context("path"), walk.language("path")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == paths
    assert [r[0] for r in df.where("path IN ('script/Go.s.sol', 'test/Vault.sol')").orderBy("path").select(walk.noise("path", True)).collect()] == ["", "ignored_dir:test"]


def test_profile(spark):
    files = ["uniswap-core/foundry.toml", "uniswap-core/src/A.sol", "uniswap-core/src/B.sol", "node/go.mod", "node/x/keeper.go", "loose.py", "node/deep/Cargo.toml", "node/deep/src/lib.rs"]
    df = spark.createDataFrame([(f,) for f in files], "path string")
    found = {r["project"]: r for r in profile.projects(df).collect()}
    assert set(found) == {"uniswap-core", "node", ".", "node/deep"}
    top = found["uniswap-core"]
    assert (top["source_files"], top["frameworks"], top["priority"]) == (2, ["foundry", "evm", "defi-protocol"], 300)
    assert top["bounty"] == 300 + 700 + 1000 + 1600 + 280 + 3000 + 900
    assert {r["cluster"]: r["projects"] for r in profile.clusters(profile.projects(df)).collect()} == {"uniswap-core": 1, "node": 2, ".": 1}
    assert profile.workspace(profile.projects(df)) and "defi" in profile.next_steps({"solidity"}, set())


def test_build_and_command_line(spark, tmp_path, capsys):
    tree = tmp_path / "tree"
    for path, text in [("src/Bank.sol", SOLIDITY), ("script/Run.s.sol", SOLIDITY), *((f"src/{p}", s) for p, s, _, _ in CODE.values())]:
        (tree / path).parent.mkdir(parents=True, exist_ok=True)
        (tree / path).write_text(text)
    out = build(spark, str(tree), str(tmp_path / "g"), include_research=True)
    assert out["status"] == "success" and out["failure_count"] == 0 and out["confidence"]["score"] == 100.0 and out["languages"]["solidity"] == 2
    g = Graph.load(spark, str(tmp_path / "g"))
    assert g.nodes.where("file = 'script/Run.s.sol'").count() and not g.production().nodes.where("file = 'script/Run.s.sol'").count()
    assert tools.run(spark, str(tmp_path / "g"), "trace", variable="balances")["accessors"]
    assert cli.main(["lookup", str(tmp_path / "g"), "--name", "withdraw", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["functions"]
    assert cli.main(["guide"]) == 0
    assert tools.profile(spark, str(tree))["projects"]


def test_files_go_by_priority_and_a_spent_budget_leaves_a_part(spark, tmp_path, monkeypatch):
    from graphloom.plans import build as builds
    from graphloom.sources import walk

    paths = ["tools/A.sol", "src/deep/B.sol", "src/C.py", "src/D.sol", "lib/src/E.sol", "script/F.s.sol"]
    files = spark.createDataFrame([(p, "python" if p.endswith("py") else "solidity") for p in paths], "path string, language string")
    got = [r.path for r in walk.numbered(files).orderBy("number").collect()]
    assert got == ["src/D.sol", "src/deep/B.sol", "src/C.py", "lib/src/E.sol", "tools/A.sol", "script/F.s.sol"]
    assert [r.path for r in walk.numbered(files, "python").orderBy("number").collect()][:3] == ["src/C.py", "src/D.sol", "src/deep/B.sol"]
    assert sorted(r.number for r in walk.numbered(files).collect()) == list(range(6))
    for p in paths[:5]:
        (tmp_path / "t" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / p).write_text("contract K { function f() public {} }")
    left, plain = [2], builds.extract.stored_rows

    def slow(rows):
        if not left[0]:
            raise builds.OutOfTime("build")
        left[0] -= 1
        return plain(rows)

    monkeypatch.setattr(builds.extract, "stored_rows", slow)
    out = build(spark, str(tmp_path / "t"), str(tmp_path / "g"), timeout=600)
    assert (out["status"], out["indexed"], out["considered"]) == ("partial", 2, 4)
    assert {r.file for r in Graph.load(spark, str(tmp_path / "g")).nodes.select("file").distinct().collect()} == {"src/D.sol", "src/deep/B.sol"}
    with pytest.raises(builds.OutOfTime):
        build(spark, str(tmp_path / "t"), str(tmp_path / "g"), timeout=600)


def test_targets_and_plan(spark):
    files = ["a/foundry.toml", *(f"a/src/A{i}.sol" for i in range(3)), "b/go.mod", *(f"b/x{i}.go" for i in range(30)), "c/Move.toml", "c/m.move", "d/Clarinet.toml", "d/k.clar", "e/foundry.toml", "e/E.sol", "f/foundry.toml", "f/F.sol", "f/G.sol", "loose.py", "a/test/T.sol", "b/test/deep/x.go"]
    found = profile.projects(spark.createDataFrame([(f,) for f in files], "path string"))
    paths = spark.createDataFrame([(f,) for f in files], "path string")
    assert [(r.place, r.project, r.files) for r in profile.by_language(found).where("language = 'solidity'").orderBy("place").collect()] == [(1, "a", 3), (2, "f", 2), (3, "e", 1)]
    recommended, risky, plan = profile.build_plan(found, 20)
    assert [r["project"] for r in recommended] == ["b", "a", "f", "e", "c", "d"]
    assert [(r["language"], r["project"]) for r in risky] == [("solidity", "a"), ("solidity", "f"), ("move", "c"), ("clarity", "d")]
    assert "." not in {r["project"] for r in recommended} and [r["project"] for r in plan] == ["b", "a", "f", "e", "c", "d"] and plan[5]["reason"] == "risk-first Stacks public functions/state target"
    first, _, _ = profile.build_plan(found, 3, "bounty")
    assert [(r["project"], r["reason"]) for r in first] == [("a", "risk-first EVM contracts"), ("f", "risk-first EVM contracts"), ("c", "risk-first Move assets/modules")]
    assert profile.build_plan(found, 0) == ([], [], [])
    shown = {(r.reason, r.language): r.path for r in profile.examples(paths).where("place = 1").collect()}
    assert shown[("", "move")] == "c/m.move" and shown[("ignored_dir:test", "")] == "a/test/T.sol" and profile.examples(paths).where("language = 'go'").count() == 5
    assert {r["name"]: r.dirs for r in profile.skipped_dirs(paths).collect()} == {"test": 2}
    assert {r.marker: r.roots for r in profile.marker_counts(paths).collect()} == {"foundry.toml": 3, "go.mod": 1, "Move.toml": 1, "Clarinet.toml": 1}
    empty = profile.projects(spark.createDataFrame([], "path string"))
    assert profile.build_plan(empty) == ([], [], []) and profile.clusters(empty).count() == 0


def test_cargo_says_the_dialect(spark, tmp_path):
    for path, text in (("sub/Cargo.toml", '[dependencies]\nanchor-lang = "1"\n'), ("sub/src/lib.rs", "pub fn f() {}"), ("sub/readme.md", "x"), ("a.SOL", "contract A {}"), ("deep/er/Cargo.toml", "soroban-sdk")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert walk.cargo_dialect(spark, str(tmp_path)) == "anchor"
    assert {r.path: r.language for r in walk.read_tree(spark, str(tmp_path)).collect()} == {"sub/src/lib.rs": "anchor", "a.SOL": "solidity"}
    (tmp_path / "Cargo.toml").write_text("frame-support")
    assert walk.cargo_dialect(spark, str(tmp_path)) == "substrate"
    assert walk.cargo_dialect(spark, str(tmp_path / "deep")) == "soroban" and walk.cargo_dialect(spark, str(tmp_path / "sub" / "src")) == ""


def test_containing_sets(spark):
    from graphloom.operators.relations import containing

    sets = spark.createDataFrame([("s", "a", "x"), ("s", "a", "y"), ("s", "a", "y"), ("s", "b", "x"), ("t", "a", "y"), ("s", "b", None)], "scope string, holder string, item string")
    wanted = spark.createDataFrame([("s", "p", "x"), ("s", "p", "y"), ("s", "q", "x"), ("t", "q", "x"), ("s", "r", "z"), ("s", "p", "x")], "scope string, name string, item string")
    assert sorted(map(tuple, containing(sets, wanted).collect())) == [("s", "a", "p"), ("s", "a", "q"), ("s", "b", "q")]
    assert containing(sets.limit(0), wanted).count() == 0 and containing(sets, wanted.limit(0)).count() == 0


def test_containing_sets_are_counted_without_their_pairs(spark):
    from graphloom.operators.relations import containing, containing_counts

    sets = spark.range(3000).selectExpr("concat('s', id % 2) AS scope", "id AS holder", "explode(sequence(0, id % 5)) AS item")
    wanted = spark.range(2000).selectExpr("concat('s', id % 2) AS scope", "id AS name", "explode(sequence(id % 3, id % 4)) AS item").union(spark.sql("SELECT 's0', 9999L, 77L UNION ALL SELECT NULL, 1L, 1L"))
    counts = containing_counts(sets, wanted)
    held, asked = {}, {}
    for rows, out in ((sets.collect(), held), (wanted.collect(), asked)):
        for scope, key, item in rows:
            if scope:
                out.setdefault((scope, key), set()).add(item)
    want = {}
    for (scope, name), a in asked.items():
        if own := [h for (s, h), x in held.items() if s == scope and a <= x]:
            want[scope, name] = (len(own), min(own))
    assert {(r.scope, r.name): (r.holders, r.first_holder) for r in counts.collect()} == want
    assert containing(sets, wanted).count() == sum(n for n, _ in want.values())
    assert counts.count() == len(want)


def test_accounts_and_interfaces_in_a_build(spark, tmp_path):
    from graphloom.plans import queries

    for name, text in (("lib.rs", queries._ANCHOR), ("k.go", queries._GO), ("P.java", queries._JAVA)):
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    build(spark, str(tmp_path / "t"), str(tmp_path / "g"))
    g = Graph.load(spark, str(tmp_path / "g"))
    edges = {(r.source, r.target, r.relation) for r in g.edges.collect()}
    assert {("lib.rs::Pay", "lib.rs::p.pay", "guards"), ("lib.rs::p.pay", "lib.rs::_sink_close_Pay_vault", "calls"), ("k.go::Both", "k.go::Store", "inherits")} <= edges
    assert ("k.go::One", "k.go::Store", "inherits") not in edges and ("lib.rs::Open", "lib.rs::p.open", "guards") not in edges
    nodes = {r.id: json.loads(r.metadata) for r in g.nodes.collect()}
    assert [r["type"] for r in nodes["lib.rs::p.open"]["anchor_risks"]] == ["missing_bump", "missing_signer", "unchecked_no_owner", "weak_pda_seeds"] and "anchor_risks" not in nodes["lib.rs::p.pay"]
    assert nodes["lib.rs::_sink_close_Pay_vault"]["sink_type"] == "fund_destruction" and nodes["P.java::Phase"]["variants"] == ["OPEN", "CLOSED"]
    assert {(r.entity, r.to_state) for r in g.transitions.collect()} == {("Item", "exists"), ("Item", "deleted"), ("Phase", "OPEN"), ("Phase", "CLOSED")}


def test_files_of_equal_content_share_their_rows(spark):
    from graphloom.plans import queries
    from graphloom.sources import extract

    texts = (("rs", "anchor", queries._ANCHOR), ("go", "go", queries._GO), ("java", "java", queries._JAVA))
    files = [(f"{d}/f.{end}", text, lang, context) for d in ("a", "a/test/b", "test") for end, lang, text in texts for context in ("production", "script")]
    got = extract.extracted(spark.createDataFrame(files, "path string, content string, language string, source_context string").coalesce(1)).collect()
    kinds = dict(zip(("node", "edge", "transition"), range(3), strict=True))
    for path, text, lang, context in files:
        parts = extract.extract(path, text, lang)
        for kind, k in kinds.items():
            rows = [r.asDict() for r in got if r.path == path and r.kind == kind and r.pos < extract.PER_EXTRACTOR]
            for want in parts[k]:
                mine = [r for r in rows if all(r[c] == v for c, v in want.items() if c != "metadata")]
                assert len(mine) == 2 * sum(all(x[c] == v for c, v in want.items() if c != "metadata") for x in parts[k]), (path, want)
            assert len(rows) == 2 * len(parts[k])
    only = extract.extracted(spark.createDataFrame(files, "path string, content string, language string, source_context string"), ("transition",)).collect()
    assert sorted(map(str, only)) == sorted(str(r) for r in got if r.kind == "transition")


def test_files_of_parts_are_dealt_out_and_meet_no_table_of_paths(spark):
    from graphloom.plans import queries

    g = queries._program(spark, "/root/testdata/sf0.001", "node", "edge", "transition")
    for table in (g.nodes, g.edges, g.transitions):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and "Join" not in plan
