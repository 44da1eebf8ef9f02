"""The inventory of a workspace: its projects by package root, what they are made with, and in which order to look at them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.names import path_hint
from graphloom.sources.walk import file_name, language, noise, skipped_dir

# Markers of package roots with their language and frameworks, and what languages and paths hint at.
MARKERS = {
    "Cargo.toml": ("rust", ("cargo",)), "Anchor.toml": ("anchor", ("anchor", "solana")), "go.mod": ("go", ("go-module",)), "package.json": ("typescript", ("node-package",)),
    "foundry.toml": ("solidity", ("foundry", "evm")), "hardhat.config.ts": ("solidity", ("hardhat", "evm")), "hardhat.config.js": ("solidity", ("hardhat", "evm")),
    "truffle-config.js": ("solidity", ("truffle", "evm")), "Move.toml": ("move", ("move-package",)), "Clarinet.toml": ("clarity", ("clarinet", "stacks/clarity")),
    "Scarb.toml": ("cairo", ("scarb", "starknet")), "Forc.toml": ("sway", ("forc", "fuel")), "tact.config.json": ("ton", ("tact", "ton")), "pom.xml": ("java", ("maven",)),
    "build.gradle": ("java", ("gradle",)), "settings.gradle": ("java", ("gradle",)), "CMakeLists.txt": ("cpp", ("cmake",)), "Makefile": ("native", ("make",)), "buf.yaml": ("proto", ("buf", "protobuf/grpc")),
}
LANGUAGE_HINTS = {
    "solidity": ("evm",), "vyper": ("evm",), "move": ("move",), "clarity": ("stacks/clarity",), "ton": ("ton",), "anchor": ("anchor", "solana"), "substrate": ("substrate",),
    "soroban": ("stellar/soroban",), "cairo": ("starknet",), "sway": ("fuel",), "xdr": ("stellar/xdr",), "proto": ("protobuf/grpc",),
}
PATH_HINTS = (
    (("layerzero", "wormhole"), ("cross-chain/messaging",)), (("axelar",), ("cosmos-sdk", "cross-chain/messaging")), (("chainlink",), ("oracle",)),
    (("lido", "aave", "compound", "uniswap", "curve", "balancer", "makerdao", "eigenlayer"), ("defi-protocol",)),
    (("op-geth", "op-node", "op-batcher", "op-proposer", "op-program", "optimism", "op-stack"), ("op-stack",)),
    (("geth", "go-ethereum", "erigon", "reth", "nethermind", "bera-geth", "l2geth"), ("evm-node", "geth-family")),
    (("cosmos", "cosmos-sdk", "tendermint", "cometbft", "ibc-go", "osmosis", "injective", "sei", "xion", "celestia"), ("cosmos-sdk",)),
    (("sui",), ("sui-move",)), (("aptos",), ("aptos-move",)), (("solana", "jito"), ("solana",)), (("stellar", "stellar-core"), ("stellar",)), (("soroban",), ("stellar/soroban",)),
    (("stacks",), ("stacks/clarity",)), (("substrate", "polkadot", "parity", "moonbeam", "hydradx", "bifrost"), ("substrate/polkadot",)), (("ton",), ("ton",)), (("hedera", "hiero"), ("hedera",)),
    (("avalanche", "subnet-evm"), ("avalanche",)), (("near",), ("near",)), (("monad",), ("monad", "evm-node")), (("polygon", "matic", "bor"), ("polygon",)), (("scroll",), ("scroll", "zk-rollup")),
    (("zksync",), ("zksync", "zk-rollup")), (("starknet", "starkware"), ("starknet",)), (("fuel",), ("fuel",)),
)
WEIGHTS = {
    "solidity": 100, "move": 95, "clarity": 95, "vyper": 95, "anchor": 92, "substrate": 90, "soroban": 90, "ton": 88, "cairo": 86, "sway": 86, "go": 82, "rust": 80, "java": 72, "cpp": 70,
    "proto": 62, "xdr": 61, "typescript": 55, "python": 50,
}
CONTRACT = ("solidity", "vyper", "move", "clarity", "ton", "anchor", "substrate", "soroban", "cairo", "sway", "xdr", "proto")
INFRASTRUCTURE = ("go", "rust", "java", "cpp", "typescript", "python", "proto")
BOOSTS = {
    "cross-chain/messaging": 2200, "defi-protocol": 1600, "evm": 1000, "foundry": 700, "hardhat": 500, "anchor": 900, "solana": 900, "sui-move": 900, "aptos-move": 900, "stacks/clarity": 800,
    "ton": 800, "stellar/soroban": 800,
}

FOCUS = {
    "solidity": "EVM contracts", "vyper": "EVM contracts", "move": "Move assets/modules", "clarity": "Stacks public functions/state", "ton": "TON message handlers/value flow",
    "anchor": "Solana account validation/CPI", "substrate": "Substrate pallets/runtime", "soroban": "Soroban auth/state", "cairo": "Starknet contracts", "sway": "Fuel contracts",
    "xdr": "Stellar protocol schemas", "proto": "RPC/protocol boundaries", "go": "node/keeper services", "rust": "node/runtime services", "java": "services/JVM protocol code",
    "cpp": "native consensus/runtime code", "typescript": "client/scripts/key handling", "python": "ops/scripts",
}
# How many projects a language recommends, how many of them are looked at for risk, what a plan holds and how much of it by weight.
PER_LANGUAGE, RISKY, PLAN, BY_WEIGHT, EXAMPLES, FRAMEWORKS = 3, 2, 8, 5, 5, 6


def _map(values: dict):
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def package_roots(files: DataFrame) -> DataFrame:
    """(root): directories that hold a marker; the tree's own is the empty text."""
    marked = files.where(file_name(F.col("path")).isin(*MARKERS))
    return marked.select(F.regexp_replace("path", "/?[^/]*$", "").alias("root")).distinct()


def projects_of(files: DataFrame) -> DataFrame:
    """files with project: the nearest directory above that holds a marker, else the first directory, `.` for the tree itself."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = files.select("path", F.explode(above).alias("root")).join(package_roots(files), "root")
    nearest = each.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    first = F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(".")
    named = files.join(nearest, "path", "left")
    return named.withColumn("project", F.when(F.col("root") == "", ".").otherwise(F.coalesce("root", first))).drop("root")


def inventory(files: DataFrame, include_research: bool = False) -> DataFrame:
    """(reason, language, files): how many files are indexed (no reason) or left out, and why."""
    rows = files.select(noise("path", include_research).alias("reason"), language("path").alias("language"))
    return rows.groupBy("reason", "language").agg(F.count("*").alias("files"))


def projects(files: DataFrame, include_research: bool = False) -> DataFrame:
    """(project, source_files, languages, markers, frameworks, priority, bounty): files, a column path, by project.

    priority weighs the files by language and the markers; bounty looks for what holds value first.
    """
    own = projects_of(files.select("path"))
    sources = own.where(noise("path", include_research) == "").groupBy("project", language("path").alias("language")).agg(F.count("*").alias("n"))
    by = sources.groupBy("project").agg(F.sum("n").alias("source_files"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))
    marks = own.where(file_name(F.col("path")).isin(*MARKERS)).groupBy("project").agg(F.array_sort(F.collect_set(file_name(F.col("path")))).alias("markers"))
    both = by.join(marks, "project", "full").withColumns({"markers": F.coalesce("markers", F.array().cast("array<string>")), "languages": F.coalesce("languages", F.expr("cast(map() as map<string,bigint>)")), "source_files": F.coalesce("source_files", F.lit(0))})
    of_markers = F.flatten(F.transform("markers", lambda m: F.element_at(F.create_map(*(x for k, (_, f) in MARKERS.items() for x in (F.lit(k), F.array(*map(F.lit, f))))), m)))
    hints = F.create_map(*(x for k, f in LANGUAGE_HINTS.items() for x in (F.lit(k), F.array(*map(F.lit, f)))))
    of_languages = F.flatten(F.transform(F.map_keys("languages"), lambda k: F.coalesce(F.element_at(hints, k), F.array().cast("array<string>"))))
    of_paths = F.flatten(F.array(*(F.when(F.array_contains(F.array(*(path_hint("project", p) for p in patterns)), True), F.array(*map(F.lit, values))).otherwise(F.array().cast("array<string>")) for patterns, values in PATH_HINTS)))
    both = both.withColumn("frameworks", F.array_distinct(F.concat(of_markers, of_languages, of_paths)))
    weight = F.aggregate(F.map_entries("languages"), F.lit(0).cast("long"), lambda a, e: a + F.coalesce(F.element_at(_map(WEIGHTS), e["key"]), F.lit(10)) * e["value"])
    bonus = F.aggregate("markers", F.lit(0), lambda a, m: a + F.coalesce(F.element_at(_map(WEIGHTS), F.element_at(_map({k: v for k, (v, _) in MARKERS.items()}), m)), F.lit(0)))
    boost = F.aggregate("frameworks", F.lit(0), lambda a, f: a + F.coalesce(F.element_at(_map(BOOSTS), f), F.lit(0)))

    def files_in(langs):
        return F.aggregate(F.map_entries(F.map_filter("languages", lambda k, v: k.isin(*langs))), F.lit(0).cast("long"), lambda a, e: a + e["value"])

    contracts = files_in(CONTRACT)
    has = lambda f: F.array_contains("frameworks", f)
    bounty = weight + bonus + boost + contracts * 140
    bounty = bounty + F.when(contracts > 0, 3000 + F.when(has("cross-chain/messaging"), 1200).otherwise(0) + F.when(has("defi-protocol"), 900).otherwise(0)).otherwise(-F.least(files_in(INFRASTRUCTURE) * 25, F.lit(15000)))
    return both.withColumns({"priority": weight + bonus, "bounty": bounty})


def clusters(found: DataFrame) -> DataFrame:
    """Projects by first directory: (cluster, projects, source_files, priority, bounty, top_projects, frameworks), the frameworks most of its projects have first."""
    order = Window.partitionBy("cluster").orderBy(F.desc("bounty"), "project")
    ranked = found.withColumn("cluster", F.substring_index("project", "/", 1)).withColumn("k", F.row_number().over(order))
    top = F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "project"))))
    rolled = ranked.groupBy("cluster").agg(F.count("*").alias("projects"), F.sum("source_files").alias("source_files"), F.max("priority").alias("priority"), F.max("bounty").alias("bounty"), F.transform(top, lambda x: x["project"]).alias("top_projects"))
    common = ranked.select("cluster", F.explode("frameworks").alias("framework")).groupBy("cluster", "framework").agg(F.count("*").alias("n"))
    common = common.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "framework"))).where(F.col("k") <= FRAMEWORKS)
    common = common.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "framework"))), lambda x: x["framework"]).alias("frameworks"))
    return rolled.join(common, "cluster", "left").withColumn("frameworks", F.coalesce("frameworks", F.array().cast("array<string>")))


def targets(found: DataFrame) -> DataFrame:
    """Projects that can be built: those with sources; the tree itself only if it has a marker or nothing else has one."""
    marked = found.agg(F.bool_or((F.size("markers") > 0) & (F.col("project") != ".")).alias("other"))
    return found.where("source_files > 0").join(F.broadcast(marked), (F.col("project") != ".") | (F.size("markers") > 0) | ~F.coalesce("other", F.lit(False))).drop("other")


def by_language(found: DataFrame, per: int = PER_LANGUAGE) -> DataFrame:
    """(language, place, project, files, priority): the projects with most files of each language."""
    each = targets(found).select("project", "priority", F.explode("languages").alias("language", "files"))
    order = Window.partitionBy("language").orderBy(F.desc("files"), F.desc("priority"), "project")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per).select("language", "place", "project", "files", "priority")


def risk_first(found: DataFrame) -> DataFrame:
    """by_language() for the first projects of contract languages, with weight and rank: they go by weight and files, both descending, then by rank."""
    chosen = by_language(found, RISKY).where(F.col("language").isin(*CONTRACT))
    return chosen.withColumns({"weight": F.element_at(_map(WEIGHTS), F.col("language")), "rank": F.array_position(F.array(*map(F.lit, CONTRACT)), F.col("language")) * 10 + F.col("place")})


def build_plan(found: DataFrame, top: int = 20, strategy: str = "balanced") -> tuple[list[dict], list[dict], list[dict]]:
    """(recommended, risk-first, plan): what to build, with the reason for each; bounty puts what is at risk first."""
    risky_all = [r.asDict() for r in risk_first(found).orderBy(F.desc("weight"), F.desc("files"), "rank").collect()]  # two rows for each contract language at most
    best = targets(found).orderBy(F.desc("bounty" if strategy == "bounty" else "priority"), F.desc("source_files"), "project").limit(max(0, top))
    weighed = [{"project": r.project, "reason": "bounty-prioritized package root" if strategy == "bounty" else "top risk-weighted package root"} for r in best.select("project").collect()]
    risky = [{"project": r["project"], "reason": f"risk-first {FOCUS[r['language']]}"} for r in risky_all]
    recommended = _distinct([*risky, *weighed] if strategy == "bounty" else weighed)[: max(0, top)]
    limit = min(max(0, top), PLAN)
    first = [{"project": r["project"], "reason": "top risk-weighted package root"} for r in recommended[: min(BY_WEIGHT, limit)]]
    plan = _distinct([*first, *({"project": r["project"], "reason": r["reason"] + " target"} for r in risky)])[:limit]
    return recommended, risky_all[: max(0, top)], plan


def _distinct(rows: list[dict]) -> list[dict]:
    first: dict[str, dict] = {}
    for row in rows:
        first.setdefault(row["project"], row)
    return list(first.values())


def examples(files: DataFrame, include_research: bool = False, n: int = EXAMPLES) -> DataFrame:
    """(reason, language, place, path): the first paths of each language that are indexed, and of each reason why sources are not (no language)."""
    rows = files.select("path", noise("path", include_research).alias("reason"), language("path").alias("language")).where("language <> 'generic'")
    rows = rows.withColumn("language", F.when(F.col("reason") == "", F.col("language")).otherwise(""))
    order = Window.partitionBy("reason", "language").orderBy("path")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("reason", "language", "place", "path")


def marker_counts(files: DataFrame) -> DataFrame:
    """(marker, roots): how many directories hold each marker."""
    return files.where(file_name(F.col("path")).isin(*MARKERS)).groupBy(file_name(F.col("path")).alias("marker")).agg(F.count("*").alias("roots"))


def skipped_dirs(files: DataFrame, include_research: bool = False) -> DataFrame:
    """(name, dirs): directories that are not looked into, counted where the way down to them is free of others."""
    parts = F.split("path", "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    flagged = F.transform(dirs, lambda d, i: F.struct(skipped_dir(d, include_research).alias("skip"), d.alias("name"), i.alias("i")))
    first = files.select(parts.alias("parts"), F.get(F.filter(flagged, lambda x: x["skip"]), F.lit(0)).alias("x")).where("x is not null")
    where = F.array_join(F.slice("parts", 1, F.col("x.i") + 1), "/")
    return first.select("x.name", where.alias("dir")).distinct().groupBy("name").agg(F.count("*").alias("dirs"))


def workspace(found: DataFrame) -> bool:
    """Whether a tree holds several projects: three clusters or six projects."""
    n = found.agg(F.count("*"), F.count_distinct(F.substring_index("project", "/", 1))).first()
    return n[0] >= 6 or n[1] >= 3


# Which reports languages or frameworks ask for.
REPORTS = (
    (CONTRACT, "cross"), (CONTRACT, "state"), (("solidity", "vyper", "move", "clarity", "ton", "cairo", "sway"), "defi"),
    (("rust", "anchor", "substrate", "soroban", "go", "java", "cpp", "typescript", "python"), "unsafe"), (("cross-chain/messaging", "op-stack", "evm-node", "cosmos-sdk"), "paths"),
)


def next_steps(languages: set[str], frameworks: set[str]) -> list[str]:
    """Which reports to ask for."""
    have = languages | frameworks
    return ["hotspots", "audit", *(report for words, report in REPORTS if have & set(words))]
