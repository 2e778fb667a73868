"""Pattern dimensions: what device commands, prompts, fillers and markers look like.

The tables are data. Functions of the library take them as defaults and accept others.
"""

from __future__ import annotations

# ---- Fixed values: command patterns by vendor, in order of precedence (first match wins) ----
VENDORS: dict[str, dict[str, tuple[str, ...]]] = {
    "cisco": {
        "exec": (r"show\s+", r"ping\s+", r"traceroute\s+", r"debug\s+", r"clear\s+", r"reload\b", r"copy\s+", r"install\s+(add|activate|commit|deactivate|remove|rollback|verify|prepare)\b", r"show\s+install\s+"),
        "config": (r"configure\s+terminal\b", r"conf\s+t\b", r"interface\s+", r"router\s+(bgp|ospf|isis|rip|eigrp)\s+", r"ip\s+(route|address|prefix-list|access-list|community-list)\s+", r"mpls\s+", r"no\s+", r"end\b", r"exit\b"),
    },
    "juniper": {
        "exec": (r"show\s+", r"ping\s+", r"traceroute\s+", r"monitor\s+", r"request\s+"),
        "config": (r"set\s+", r"delete\s+", r"deactivate\s+", r"activate\s+", r"commit\b", r"rollback\s*\d*\b", r"edit\s+", r"run\s+"),
    },
    "nokia": {"exec": (r"show\s+", r"ping\s+", r"traceroute\s+", r"tools\s+", r"debug\s+"), "config": (r"configure\s+", r"info\s+", r"admin\s+")},
    "arista": {"exec": (r"show\s+", r"ping\s+", r"traceroute\s+"), "config": (r"configure\b", r"interface\s+", r"router\s+", r"no\s+")},
    "f5": {
        "exec": (r"tmsh\s+show\s+", r"tmsh\s+list\s+", r"tmsh\s+run\s+", r"show\s+sys\s+", r"show\s+ltm\s+", r"show\s+net\s+"),
        "config": (r"tmsh\s+modify\s+", r"tmsh\s+create\s+", r"tmsh\s+delete\s+", r"tmsh\s+save\b", r"modify\s+(ltm|net|sys)\s+", r"create\s+(ltm|net|sys)\s+", r"save\s+sys\s+config\b"),
    },
    "palo_alto": {
        "exec": (r"show\s+system\s+", r"show\s+interface\s+", r"show\s+routing\s+", r"show\s+session\s+", r"show\s+security\s+", r"debug\s+", r"test\s+(security-policy|routing)\s+"),
        "config": (r"set\s+(deviceconfig|network|vsys|shared)\s+", r"edit\s+", r"delete\s+", r"commit\b", r"request\s+(system|license)\s+"),
    },
    "checkpoint": {
        "exec": (r"show\s+(configuration|route|interface|version)\b", r"fw\s+", r"cpinfo\b", r"cphaprob\b", r"clish\s+", r"cpstop\b", r"cpstart\b"),
        "config": (r"set\s+(interface|route|hostname|timezone)\s+", r"add\s+route\b", r"delete\s+route\b", r"save\s+config\b"),
    },
    "huawei": {
        "exec": (r"display\s+", r"ping\s+", r"tracert\s+", r"reset\s+"),
        "config": (r"system-view\b", r"interface\s+", r"bgp\s+\d+", r"ospf\s+", r"isis\s+", r"undo\s+", r"commit\b", r"return\b", r"quit\b"),
    },
    "ericsson": {"exec": (r"show\s+", r"context\s+", r"service\s+show\s+"), "config": (r"configure\s+", r"context\s+\w+\s+router", r"no\s+", r"commit\b")},
    "generic": {"exec": (r"show\s+", r"display\s+", r"ping\s+", r"traceroute\s+", r"tracert\s+"), "config": ()},
}
VENDOR_BOOST = 0.2
GENERIC_BOOST = 0.0

# ---- Fixed values: indicators of a command of no known vendor ----
GENERIC: tuple[str, ...] = (
    r"show\s+\w", r"ping\s+\S", r"traceroute\s+\S", r"configure\b", r"conf\s+t\b", r"set\s+\w", r"no\s+\w", r"interface\s+\w", r"router\s+(bgp|ospf|isis|rip|eigrp)", r"commit\b", r"rollback\b", r"ip\s+(route|address|bgp|ospf|prefix)",
    r"delete\s+\w", r"deactivate\s+", r"activate\s+", r"edit\s+\w", r"run\s+show\s+", r"request\s+system", r"display\s+\w", r"undo\s+\w", r"system-view\b", r"tracert\s+\S", r"quit\b", r"tmsh\s+", r"modify\s+(ltm|net|sys)\s+",
    r"create\s+(ltm|net|sys)\s+", r"save\s+sys\s+config", r"test\s+(security-policy|routing|nat-policy)", r"fw\s+", r"cpinfo\b", r"cpstop\b", r"cpstart\b", r"clish\s+", r"context\s+\w", r"service\s+show\s+",
)

# ---- Fixed values: protocols by keyword and by command prefix, in order of precedence ----
PROTOCOLS: dict[str, dict[str, tuple[str, ...]]] = {
    "bgp": {"keywords": ("bgp", "as-path", "neighbor", "route-reflector", "community", "confederation", "peer-group", "ebgp", "ibgp"), "commands": ("show ip bgp", "show bgp", "show route protocol bgp", "show bgp summary", "show ip bgp summary", "show bgp neighbor", "show bgp ipv4", "show bgp ipv6")},
    "ospf": {"keywords": ("ospf", "area", "lsa", "spf", "dr", "bdr", "hello", "dead-interval"), "commands": ("show ip ospf", "show ospf", "show ip ospf neighbor", "show ip ospf database", "show ospf neighbor", "show ospf database")},
    "isis": {"keywords": ("isis", "level-1", "level-2", "level1", "level2", "net", "clns", "csnp", "lsp"), "commands": ("show isis", "show clns", "show isis neighbor", "show isis database")},
    "mpls": {"keywords": ("mpls", "ldp", "rsvp", "label", "lsp", "te", "traffic-engineering", "vpn", "l3vpn", "l2vpn"), "commands": ("show mpls", "show label", "show ldp", "show rsvp", "show mpls forwarding", "show mpls ldp neighbor")},
    "interface": {"keywords": ("interface", "shutdown", "no shutdown", "bandwidth", "mtu", "duplex", "speed", "encapsulation"), "commands": ("show interface", "show ip interface", "show interfaces")},
    "vlan": {"keywords": ("vlan", "trunk", "access", "switchport", "dot1q", "802.1q"), "commands": ("show vlan", "show interfaces trunk", "show vlan brief")},
    "system": {"keywords": ("ntp", "snmp", "syslog", "logging", "aaa", "tacacs", "radius", "ssh", "telnet"), "commands": ("show ntp", "show clock", "show users", "show logging", "show version", "display ntp", "display version")},
    "firewall": {"keywords": ("firewall", "acl", "access-list", "policy", "nat", "zone", "permit", "deny", "inspect", "stateful"), "commands": ("show firewall", "show access-list", "show nat", "fw stat", "fw ctl", "show security policy", "show ip access-list")},
    "lb": {"keywords": ("virtual-server", "pool", "node", "load-balance", "health-monitor", "persistence", "irule", "ltm", "slb"), "commands": ("show ltm virtual", "show ltm pool", "show ltm node", "tmsh show ltm", "show run ltm")},
}
#: Keywords that stand in several protocols.
AMBIGUOUS = ("neighbor", "area", "level", "mode")

# ---- Fixed values: device prompts, stripped in this order ----
PROMPTS: tuple[str, ...] = (
    r"^\S+[>#]\s*", r"^\[\S+\]\s*[>#]\s*", r"^RP/\d+/[\w/]+:[\w.-]+(?:\([^)]*\))?[>#]\s*", r"^PE\d+[>#]\s*", r"^CE\d+[>#]\s*", r"^R\d+[>#]\s*", r"^\S+\(config[\w-]*\)[>#]\s*", r"^\[edit[^\]]*\]\s*", r"^\w+@[\w.-]+[>#]\s*", r"^<[\w.-]+>\s*", r"^\w+@\S+\([^)]+\)[>#]\s*",
)

# ---- Fixed values: filler phrases and what stands for them, in this order ----
FILLERS: tuple[tuple[str, str], ...] = (
    (r"\bplease note that\b", ""), (r"\bplease note:\s*", ""), (r"\bensure that\b", ""), (r"\bmake sure (to|that)\b", ""), (r"\bthe operator should\b", ""), (r"\bit is required to\b", ""), (r"\bit is recommended (to|that)\b", ""), (r"\bplease\b", ""), (r"\bin order to\b", "to"), (r"\bprior to\b", "before"),
    (r"\bsubsequent to\b", "after"), (r"\bso as to\b", "to"), (r"\bit should be noted that\b", ""), (r"\bfor the purpose of\b", "for"), (r"\bat this point in time\b", "now"), (r"\bbe sure to\b", ""), (r"\bkindly\b", ""), (r"\bonce completed?,?\s*", ""), (r"\bwhen done,?\s*", ""), (r"\bas (per|mentioned above),?\s*", ""),
    (r"\bif applicable,?\s*", ""), (r"\bfor example,?\s*", "e.g. "), (r"\bnote:\s*", ""),
)

# ---- Fixed values: signs of an actionable paragraph, with the most points each can give ----
SIGNIFICANCE: tuple[tuple[int, str], ...] = (
    (3, r"(?i)\b(configure|verify|check|enable|disable|install|connect|validate|test|ping|traceroute|remove|add|apply|deploy|activate|deactivate|restart|reboot|reload|shutdown|bring up|bring down|set|get|confirm|ensure|establish|clear|reset|delete|create|modify|update|copy|paste|save|commit|rollback|revert|undo|display|show)\b"),
    (2, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?:/\d{1,2})?\b"),
    (2, r"\b[0-9a-fA-F]{1,4}(:[0-9a-fA-F]{0,4}){2,7}\b"),
    (2, r"(?i)\b(GigabitEthernet|TenGigabitEthernet|HundredGigE|FastEthernet|Ethernet|Bundle-Ether|ae\d+|xe-[\d/]+|et-[\d/]+|ge-[\d/]+|te[\d/]+|gi[\d/]+|fa[\d/]+|lo\d+|tun\d+|Loopback|Tunnel|Port-channel|management|mgmt|vlan|BDI|BVI|IRB)\d*[\d/.:-]*\b"),
    (1, r"(?i)\b(AS|ASN)\s*\d+\b"),
    (1, r"(?i)\bvlan\s*\d+\b"),
    (1, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}/\d{1,2}\b"),
    (1, r"\bPE\d+|CE\d+|P\d+-\w+|R\d+\b"),
)
#: Those of them that match no text without a digit or a colon.
SIGNS_WITH_DIGITS = tuple(p for _, p in SIGNIFICANCE[1:3] + SIGNIFICANCE[4:8])
# ---- Fixed values: phrases that announce an expected output, and the group that holds it ----
EXPECTATIONS: tuple[tuple[str, int], ...] = (
    (r"(?i)expected[:\s]+(.{10,120})", 1), (r"(?i)verify\s+that\s+(.{10,120})", 1), (r"(?i)should\s+show\s+(.{10,120})", 1), (r"(?i)should\s+see\s+(.{10,120})", 1), (r"(?i)output\s+should\s+(be\s+)?(.{10,120})", 2), (r"(?i)confirm\s+(?:that\s+)?(.{10,120})", 1), (r"(?i)state\s+(?:is|should be)\s+(.{5,80})", 1), (r"(?i)result[:\s]+(.{10,120})", 1),
)
#: A word that stands in each of these phrases.
EXPECTATION_WORDS = r"(?i)expected|verify|should|confirm|state|result"
ROLLBACK_SECTION = r"(?i)\b(rollback|backout|back.?out|recovery|revert|undo|restore|fallback)\b"

# ---- Fixed values: what a command's words say about its phase ----
PRE_CHECK_WORDS = r"(?i)\b(show|display|verify|check|ping|traceroute|get|status|state|baseline|confirm|validate)\b"
ROLLBACK_WORDS = r"(?i)\b(rollback|undo|revert|remove|delete|no\s+|restore|deactivate|shutdown)\b"
VERIFY_WORDS = r"(?i)\b(show|display|ping|traceroute|verify|check|test|confirm|assert|expected|after|post)\b"

# ---- Fixed values: document lines ----
HEADING = r"^(#{1,6})\s+(.+)$"
NUMBERED = r"^\s*(\d+[\.\)]\s+|\d+\.\d+[\.\)]\s+)"
STEP = r"(?i)^\s*Step\s+\d+\s*[-:.]?\s*"
BULLET = r"^\s*[-•◦▪▸*]\s+"
BOILERPLATE = r"(?i)^\s*Page\s+\d+\s*(of\s+\d+)?\s*$|^\s*\d+\s*$"
COLUMN_SYNONYMS: dict[str, tuple[str, ...]] = {
    "step": ("step", "no", "#", "seq", "sequence", "id", "num"),
    "action": ("action", "description", "task", "procedure", "command", "activity", "what to do"),
    "expected": ("expected", "result", "expected result", "verification", "verify", "output", "expected output"),
    "rollback": ("rollback", "backout", "undo", "revert", "recovery"),
    "notes": ("notes", "note", "comment", "remarks", "remark"),
}

# ---- Fixed values: execution ----
DEVICE_ERROR = r"(?i)\b(error|invalid|fail(ed)?|not\s+found|% unknown|% bad|% incomplete|% ambiguous|connection refused|timed?\s*out|syntax error|permission denied|not\s+permitted)\b"
NON_IDEMPOTENT = ("undo ", "no ", "delete ", "reload", "erase", "shutdown", "format ")
FATAL_ERRORS = ("permission denied", "authentication failed", "no route to host", "connection refused", "host key verification failed")
BLOCKED_COMMANDS = (r"^write erase\b", r"^format\s+", r"^crypto key zeroize\b", r"^delete nvram:\b")
STATE_KEYWORDS = ("Established", "Up", "Active", "Connected", "enabled", "ACTIVE", "FULL", "2-Way")
REFUSALS = ("i'm unable to process this request", "i cannot process this request", "i cannot assist with this", "i can't assist with this", "i won't process", "i must decline", "i am unable to assist", "not appropriate for me to", "i'm not able to help with this")


def anchored(patterns: tuple[str, ...]) -> str:
    """One case-insensitive alternation of patterns that all start at the beginning."""
    return "(?i)^(?:" + "|".join(patterns) + ")"


def keyword(words: tuple[str, ...]) -> str:
    """One alternation of whole words, ambiguous ones left out."""
    return r"\b(?:" + "|".join(w.replace(".", r"\.") for w in words if w not in AMBIGUOUS) + r")\b"
