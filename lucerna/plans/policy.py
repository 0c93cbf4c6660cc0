"""The label policy, candidates and fact rules of the registered queries, over the part dimensions."""

POLICY_ID = "PARTS_v1"
RULES = [
    {"kc_id": "K_PROMO", "rule": {"cell": {"kind": "PROMO"}}},
    {"kc_id": "K_BASIC", "rule": {"cell": {"kind": ["ECONOMY", "STANDARD"]}}},
    {"kc_id": "K_SIZED", "rule": {"cell": {"kind": ["SMALL", "MEDIUM"]}}},
    {"kc_id": "K_LOW_BAND", "rule": {"cell": {"size": ["S0", "S1"]}}},
    {"kc_id": "K_HIGH_BAND", "rule": {"cell": {"size": ["S3", "S4"]}}},
    {"kc_id": "K_BRAND0", "rule": {"cell": {"brand": "B0"}}},
    {"kc_id": "K_BRAND1", "rule": {"cell": {"brand": "B1"}}},
    {"kc_id": "K_RED", "rule": {"operation": "red"}},
    {"kc_id": "K_WARMTH", "rule": {"any": [{"operation": "hot"}, {"operation": "cold"}]}},
    {"kc_id": "K_FASTENER", "rule": {"any": [{"operation": "bolt"}, {"operation": "gear"}]}},
    {"kc_id": "K_COLD_HIGH", "rule": {"all": [{"operation": "cold"}, {"cell": {"size": ["S3", "S4"]}}]}},
]
INTERACTION_RULES = [{"kc_id": "K_BASIC_BRAND0", "rule": {"all": [{"cell": {"kind": ["ECONOMY", "STANDARD"]}}, {"cell": {"brand": "B0"}}]}}]
FACT_RULES = [
    {"rule": {"cell": {"kind": ["SMALL", "MEDIUM", "LARGE"]}}, "fact": "sized"},
    {"rule": {"cell": {"kind": ["ECONOMY", "STANDARD"]}}, "template": "basic:{kind}"},
    {"rule": {"cell": {"size": ["S0", "S1"]}}, "template": "low:{size}"},
    {"rule": {"cell": {"size": ["S3", "S4"]}}, "fact": "high"},
    {"rule": {"cell": {"brand": ["B0", "B1"]}}, "template": "brand:{brand}"},
]
#: If the first part holds, the second must.
IMPLICATIONS = [
    ("promo is never B2", {"cell": {"kind": "PROMO"}}, {"cell": {"brand": ["B0", "B1"]}}),
    ("economy has low size", {"cell": {"kind": "ECONOMY"}}, {"cell": {"size": ["S0", "S1", "S2"]}}),
    ("small has size S0 or S1", {"cell": {"kind": "SMALL"}}, {"cell": {"size": ["S0", "S1"]}}),
]
#: Candidate labels of the selection queries: (id, origin rank, granularity, complexity, parents, what it stands for, rule), some
#: with a group of alternatives.
CANDIDATES = [
    ("C_KIND_" + k, 0, 1, 1, [], f"kind:{k}", {"cell": {"kind": k}}) for k in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
] + [
    ("C_SIZE_" + s, 0, 1, 1, [], f"size:{s}", {"cell": {"size": s}}) for s in ("S0", "S1", "S2", "S3", "S4")
] + [
    ("C_BRAND_" + b, 0, 1, 1, [], f"brand:{b}", {"cell": {"brand": b}}) for b in ("B0", "B1", "B2")
] + [
    ("C_LOW", 0, 0, 2, [], "size:low", {"cell": {"size": ["S0", "S1"]}}, "low sizes"),
    ("C_LOW_AGAIN", 1, 0, 2, [], "size:low", {"any": [{"cell": {"size": "S0"}}, {"cell": {"size": "S1"}}]}, "low sizes"),
    ("C_RED", 1, 1, 1, [], "", {"operation": "red"}),
    ("C_ECONOMY_B0", 2, 2, 3, ["C_KIND_ECONOMY", "C_BRAND_B0"], "", {"all": [{"cell": {"kind": "ECONOMY"}}, {"cell": {"brand": "B0"}}]}),
    ("C_SMALL_S0", 2, 2, 3, ["C_KIND_SMALL", "C_SIZE_S0"], "", {"all": [{"cell": {"kind": "SMALL"}}, {"cell": {"size": "S0"}}]}),
]
#: Facts that may show more in an interaction's cells than its parents explain.
PATTERNS = {"C_ECONOMY_B0": ["kind:ECONOMY", "pair:ECONOMY+B0"], "C_SMALL_S0": ["kind:SMALL", "size:S0"]}
#: Distinct source descriptors (suppliers) that a candidate's cells need.
LEAST_DESCRIPTORS = 5
