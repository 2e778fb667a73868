"""Test suites over a device fleet, and its discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procflow.operators import reach
from procflow.session import checkpointed, kept


def resolve_devices(instances: DataFrame, os_defaults: DataFrame, models: DataFrame) -> DataFrame:
    """Devices with OS defaults, their model and their own values: protocols and features are united and sorted,
    scalars are the instance's where given. ``instances`` has device, vendor, os, model_key, version, role, host,
    port, protocols, features."""
    o = os_defaults.select("vendor", "os", F.col("protocols").alias("__op"), F.col("features").alias("__of"), F.col("port").alias("__oport"))
    m = models.select("vendor", "os", "model_key", "model", F.col("protocols").alias("__mp"), F.col("features").alias("__mf"))
    d = instances.join(o, ["vendor", "os"], "left").join(m, ["vendor", "os", "model_key"], "left")
    none = F.array().cast("array<string>")
    union = lambda *cs: F.array_sort(F.array_distinct(F.concat(*[F.coalesce(F.col(c), none) for c in cs])))
    return d.select("device", "vendor", "os", "model", "version", "role", "host", F.coalesce("port", "__oport", F.lit(22)).alias("port"), union("__op", "__mp", "protocols").alias("protocols"), union("__of", "__mf", "features").alias("features"))


def select_devices(devices: DataFrame, names: list[str] | None = None, vendor: str | None = None, role: str | None = None, protocol: str | None = None) -> DataFrame:
    """Devices by name, vendor, role and protocol, as far as given."""
    for value, test in ((names, lambda v: F.col("device").isin(v)), (vendor, lambda v: F.col("vendor") == v), (role, lambda v: F.col("role") == v), (protocol, lambda v: F.array_contains("protocols", v))):
        if value is not None:
            devices = devices.where(test(value))
    return devices


def test_plan(devices: DataFrame, catalog: DataFrame, test_type: str) -> DataFrame:
    """Each device with each test of the type for each protocol that it supports."""
    d = devices.select("device", "vendor", "os", F.explode("protocols").alias("protocol"))
    return d.join(catalog.where(F.col("test_type") == test_type), "protocol")


#: Commands by intent and vendor (fixed values): words of the intent (all of them, in one of their spellings),
#: commands, default, success, error.
INTENTS = (
    (("bgp", "neighbor"), {"cisco": "show bgp ipv4 unicast summary", "juniper": "show bgp summary", "nokia": "show router bgp summary", "arista": "show bgp summary", "huawei": "display bgp peer", "ericsson": "show bgp neighbors"}, "show bgp summary", "Established|Establ", "Idle|Active|Connect"),
    (("isis|is-is",), {"cisco": "show isis neighbors", "juniper": "show isis adjacency", "nokia": "show router isis adjacency", "arista": "show isis neighbors", "huawei": "display isis peer"}, "show isis neighbors", "Up|UP", "Down|Init|None"),
    (("ldp|mpls",), {"cisco": "show mpls ldp neighbor", "juniper": "show ldp session", "nokia": "show router ldp session", "arista": "show mpls ldp neighbors", "huawei": "display mpls ldp session"}, "show mpls ldp neighbor", "Operational|Oper", "Non-Existent|Down"),
    (("cpu",), {"cisco": "show processes cpu", "juniper": "show system processes extensive | head 5", "nokia": "show system cpu", "arista": "show processes top once | head 5", "huawei": "display cpu-usage"}, "show processes cpu", r"\d+", "Error"),
    (("interface",), {"cisco": "show interfaces brief", "juniper": "show interfaces terse", "nokia": "show port", "arista": "show interfaces status", "huawei": "display interface brief"}, "show interfaces brief", "up|Up|UP", "down|Down|DOWN|err"),
)
DEFAULT_INTENT = ("show version", "Version|version", "Error|error")


def heuristic_command(intent: Column, vendor: Column) -> Column:
    """Struct of command, success_pattern, error_pattern for an intent, by its words and the vendor."""
    low = F.lower(intent)
    pair = lambda c, s, e: F.struct(c.alias("command"), F.lit(s).alias("success_pattern"), F.lit(e).alias("error_pattern"))
    out = None
    for words, by_vendor, default, good, bad in INTENTS:
        hit = F.lit(True)
        for w in words:
            hit = hit & reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in w.split("|")])
        command = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in by_vendor.items() for x in kv]), vendor), F.lit(default))
        out = F.when(hit, pair(command, good, bad)) if out is None else out.when(hit, pair(command, good, bad))
    c, s, e = DEFAULT_INTENT
    return out.otherwise(pair(F.lit(c), s, e))


def translate(plan: DataFrame, cache: DataFrame) -> DataFrame:
    """``plan`` plus command, success_pattern, error_pattern and from_cache: the cache by (vendor, os, test_id)
    first, the heuristic else."""
    c = cache.select("vendor", "os", F.col("intent_id").alias("test_id"), F.struct("command", "success_pattern", "error_pattern").alias("__hit"))
    d = plan.join(c, ["vendor", "os", "test_id"], "left").withColumn("from_cache", F.col("__hit").isNotNull())
    return d.withColumn("__t", F.coalesce("__hit", heuristic_command(F.col("intent"), F.col("vendor")))).select(*plan.columns, "from_cache", "__t.command", "__t.success_pattern", "__t.error_pattern")


def new_cache_entries(translated: DataFrame, cache: DataFrame) -> DataFrame:
    """Translations that the cache does not hold yet."""
    d = translated.select("vendor", "os", F.col("test_id").alias("intent_id"), "command", "success_pattern", "error_pattern").dropDuplicates(["vendor", "os", "intent_id"])
    return d.join(cache, ["vendor", "os", "intent_id"], "left_anti")


def device_reports(results: DataFrame) -> DataFrame:
    """Per suite, device and protocol: passed, failed, failed critical tests and the overall status."""
    bad = F.col("status") == "FAIL"
    g = results.groupBy("suite_id", "device", "protocol").agg(F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(bad).alias("failed"), F.count_if(bad & (F.col("severity") == "critical")).alias("critical_failures"), F.bool_and("reachable").alias("reachable"))
    return g.withColumn("overall", F.when(~F.col("reachable"), "UNREACHABLE").when(F.col("critical_failures") > 0, "FAIL").when(F.col("failed") > 0, "WARN").otherwise("PASS"))


def suite_status(reports: DataFrame) -> DataFrame:
    g = reports.groupBy("suite_id").agg(F.count("*").alias("n_reports"), F.bool_or(F.col("overall") == "FAIL").alias("f"), F.bool_or(F.col("overall").isin("WARN", "UNREACHABLE")).alias("w"))
    return g.select("suite_id", "n_reports", F.when(F.col("f"), "FAIL").when(F.col("w"), "WARN").otherwise("PASS").alias("overall"))


# ---- Fixed values: signs of a platform in version texts (first match wins), and where its details stand ----
# sign, vendor, os, (pattern, default) of version, model and hostname
VERSION_RULES = (
    ("ios[ -]xr", "cisco", "ios-xr", (r"Version\s+(\S+)", "unknown"), (r"cisco\s+(ASR|NCS|CRS)[\w\-]+", "ASR9000"), (r"(\S+)\s+uptime", "unknown")),
    ("ios[ -]xe", "cisco", "ios-xe", (r"Version\s+([\d\.]+)", "unknown"), (r"cisco\s+(ISR|ASR|CSR)[\w\-]+", "unknown"), (r"(\S+)\s+uptime", "unknown")),
    ("nx-?os", "cisco", "nxos", (r"NXOS:\s+version\s+(\S+)", "unknown"), (r"cisco\s+(Nexus)[\w\s]+", "Nexus9K"), (r"Device name:\s+(\S+)", "unknown")),
    ("junos|juniper", "juniper", "junos", (r"JUNOS\s+(\S+)", "unknown"), (r"Model:\s+(\S+)", "MX"), (r"Hostname:\s+(\S+)", "unknown")),
    ("nokia|sr os|timos", "nokia", "sros", (r"TiMOS-[BCMP]\-(\S+)", "unknown"), (r"(7[2457]\d\d[- ]\S+)", "7750-SR"), (r"System Name\s*:\s*(\S+)", "unknown")),
    ("arista|eos", "arista", "eos", (r"EOS version:\s+(\S+)", "unknown"), (r"Arista\s+(DCS-[\w\-]+)", "7280"), (r"Hostname:\s+(\S+)", "unknown")),
    ("huawei|vrp", "huawei", "vrp", (r"VRP.*?V(\S+)", "unknown"), (r"Huawei\s+(NE\w+)", "NE40E"), (r"<(\S+)>", "unknown")),
)


def detect_version(output: Column) -> Column:
    """Struct of vendor, os, model, version and hostname from the text of a version command."""
    get = lambda p: F.coalesce(F.nullif(F.trim(F.regexp_extract(output, "(?i)" + p[0], 1)), F.lit("")), F.lit(p[1]))
    out = None
    for sign, vendor, os_, version, model, host in VERSION_RULES:
        value = F.struct(F.lit(vendor).alias("vendor"), F.lit(os_).alias("os"), get(model).alias("model"), get(version).alias("version"), get(host).alias("hostname"))
        out = F.when(output.rlike("(?i)" + sign), value) if out is None else out.when(output.rlike("(?i)" + sign), value)
    return out.otherwise(F.struct(*[F.lit("unknown").alias(c) for c in ("vendor", "os", "model", "version", "hostname")]))


def neighbour_addresses(output: Column) -> Column:
    """Addresses in a neighbour listing: those after a mention of management addresses, else any; each once."""
    ip = r"(\d{1,3}(?:\.\d{1,3}){3})"
    managed = F.regexp_extract_all(output, F.lit("(?s)Management Addresses.*?" + ip), F.lit(1))
    return F.array_distinct(F.when(F.size(managed) > 0, managed).otherwise(F.regexp_extract_all(output, F.lit(ip), F.lit(1))))


def discover(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """``seed, node, distance``: what is reachable from each seed within ``depth`` steps, nearest distance first
    (breadth first, so none is visited twice). ``edges`` has src and dst.

    Walks meet in the same nodes over and over, so nodes of neighbouring numbers are taken together as sets, and walks
    are united by their bits before they are spread to rows at the end (``operators/reach.py``). Nodes that are no whole
    numbers are numbered first. Each round is cut from its lineage; the visited set never leaves the cluster. Runs jobs
    while it is called."""
    if not all(d.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for d, c in ((edges, "src"), (edges, "dst"), (seeds, "node"))):
        return _discover_named(edges, seeds, depth)
    named, kind = seeds.schema["node"].dataType, edges.schema["dst"].dataType
    start = seeds.select(F.col("node").alias("seed"), "node").distinct()
    out = [start.select("seed", "node", F.lit(0).alias("distance"))]
    links = kept(_bits(edges, "src", "dst"), "links") if depth else None
    found = [kept(_bits(start, "seed", "node"), "start")] if depth else []
    for k in range(1, depth + 1):
        found.append(reach.step(found[-1], links, found, "reached"))
        out.append(reach.spread(found[-1]).select(F.col("key").cast(named).alias("seed"), F.col("node").cast(kind).alias("node"), F.lit(k).alias("distance")))
    return reduce(DataFrame.unionByName, out)


_bits = reach.sets


def _discover_named(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """discover() of nodes of any type, by numbers in their order, so that neighbours in it share words."""
    from procflow.operators import ordered

    names = edges.select(F.col("src").alias("name")).union(edges.select("dst")).union(seeds.select("node")).where("name IS NOT NULL").distinct()
    ids = kept(ordered.numbered(names, [], ["name"], "id"), "names")
    to = lambda c: ids.select(F.col("name").alias(c), F.col("id").alias(f"__{c}"))
    e = edges.join(to("src"), "src").join(to("dst"), "dst", "left").select(F.col("__src").alias("src"), F.col("__dst").alias("dst"))
    got = discover(e, seeds.join(to("node"), "node", "left").select(F.col("__node").alias("node")), depth)
    return got.withColumnRenamed("seed", "__seed").withColumnRenamed("node", "__node").join(to("seed"), "__seed", "left").join(to("node"), "__node", "left").select("seed", "node", "distance")


def discover_nearest(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """``node, distance``: what is reachable from any of the seeds within ``depth`` steps, with the least number of
    steps. One row a node, however many seeds there are; the edges are cut from what made them, as every round reads
    them."""
    edges = checkpointed(edges.select("src", F.col("dst").alias("node")).distinct())
    found = front = seeds.select("node", F.lit(0).alias("distance")).distinct()
    for k in range(1, depth + 1):
        step = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select("node").distinct()
        front = checkpointed(step.join(found, "node", "left_anti").withColumn("distance", F.lit(k)))
        found = found.unionByName(front)
    return found


# ---- Fixed values: inventory templates by vendor and OS ----
TEMPLATE_REFS = {
    ("cisco", "ios-xr"): "cisco/ios-xr/asr9000",
    ("cisco", "ios-xe"): "cisco/ios-xe/asr1000",
    ("cisco", "nxos"): "cisco/nxos/nexus9k",
    ("juniper", "junos"): "juniper/junos/mx-series",
    ("nokia", "sros"): "nokia/sros/7750-sr",
    ("arista", "eos"): "arista/eos/7280",
    ("huawei", "vrp"): "huawei/vrp/ne40e",
    ("ericsson", "ipos"): "ericsson/ipos/smartedge",
}


def topology_rows(found: DataFrame, default: str = "cisco/ios-xr/asr9000") -> DataFrame:
    """Inventory rows of discovered hosts (host, vendor, os, hostname): a name, the template by vendor and OS, and
    the name of the variable that holds its credentials."""
    name = F.when(F.coalesce("hostname", F.lit("unknown")) == "unknown", F.concat(F.lit("device_"), F.replace("host", F.lit("."), F.lit("_")))).otherwise(F.col("hostname"))
    refs = F.create_map(*[F.lit(x) for (v, o), r in TEMPLATE_REFS.items() for x in (f"{v}/{o}", r)])
    ref = F.coalesce(F.try_element_at(refs, F.concat_ws("/", "vendor", "os")), F.lit(default))
    return found.select(name.alias("device"), "host", ref.alias("ref"), F.concat(F.upper(F.regexp_replace(name, r"[^A-Za-z0-9]", "_")), F.lit("_PASSWORD")).alias("credential"))


#: Device groups (fixed values): name, role filter, vendor filter.
GROUPS = (
    ("all_pe", ("pe-router",), ()), ("all_p", ("p-router",), ()), ("all_rr", ("route-reflector",), ()), ("all_cisco", (), ("cisco",)), ("all_juniper", (), ("juniper",)), ("all_nokia", (), ("nokia",)), ("core_facing", ("pe-router", "p-router"), ()),
)


def group_members(devices: DataFrame, groups=GROUPS) -> DataFrame:
    """``group, device``. The groups are a short fixed list, so each device carries its own."""
    none = F.lit(None).cast("string")
    names = []
    for name, roles, vendors in groups:
        hit = F.lit(True)
        if roles:
            hit = hit & F.col("role").isin(*roles)
        if vendors:
            hit = hit & F.col("vendor").isin(*vendors)
        names.append(F.when(hit, F.lit(name)).otherwise(none))
    return devices.select("device", F.explode(F.filter(F.array(*names), lambda g: g.isNotNull())).alias("group"))
