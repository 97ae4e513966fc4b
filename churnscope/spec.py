"""Role specs: which column is the key, the target, numeric or categorical.

Every operator takes a ``RoleSpec`` so the same code runs on the 954-row golden
table and on the fixture views derived from the driver tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class BinSpec:
    """Right-closed bins ``(edges[i], edges[i+1]]`` with one label per bin."""
    column: str
    edges: tuple
    labels: tuple
    name: str

    def __post_init__(self):
        if len(self.labels) != len(self.edges) - 1:
            raise ValueError("need one label per bin")


@dataclass(frozen=True)
class RoleSpec:
    key: str
    target: str
    numeric: tuple
    categorical: tuple
    # EDA extras
    age: str | None = None
    services: str | None = None
    age_bins: BinSpec | None = None
    service_bins: BinSpec | None = None
    # (first, second) pairs for the two-way interaction tables
    interactions: tuple = ()
    # (display name, column, {value: code} or None) for the correlation matrix
    corr_columns: tuple = ()
    target_display: str = "Churn"
    # column -> the reference's column it stands for (business rules are written for those)
    analog: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    @property
    def features(self) -> list:
        return list(self.numeric) + list(self.categorical)


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
# ---------------------------------------------------------------------------
AGE_EDGES = (20, 30, 40, 50, 60)
AGE_LABELS = ("20-29", "30-39", "40-49", "50-59")
SERVICE_EDGES = (0, 2, 4, 6)
SERVICE_LABELS = ("Low (1-2)", "Medium (3-4)", "High (5-6)")
TARGET_LABELS = {0: "No Churn", 1: "Churned"}
FLYER_CODES = {"Yes": 1, "No": 0, "No Record": 0}
YES_NO_CODES = {"Yes": 1, "No": 0}
INCOME_CODES = {"Low Income": 0, "Middle Income": 1, "High Income": 2}
SPLIT_TEST_SIZE = 0.2
SPLIT_SEED = 42
OUTLIER_K = 1.5
SIGNIFICANT_FACTOR = 0.02
# ---------------------------------------------------------------------------


# The fixture view ``churn_features`` (see sources/fixtures.py).
CHURN_SPEC = RoleSpec(
    key="customer_id",
    target="target",
    numeric=("age", "services"),
    categorical=("frequent_buyer", "income_class", "has_urgent", "has_pending"),
    age="age",
    services="services",
    age_bins=BinSpec("age", AGE_EDGES, AGE_LABELS, "age_group"),
    service_bins=BinSpec("services", SERVICE_EDGES, SERVICE_LABELS, "services_group"),
    interactions=(("income_class", "frequent_buyer"), ("services_group", "has_pending")),
    corr_columns=(
        ("age", "age", None),
        ("services", "services", None),
        ("churn", "target", None),
        ("frequent_buyer", "frequent_buyer", FLYER_CODES),
        ("has_urgent", "has_urgent", YES_NO_CODES),
        ("has_pending", "has_pending", YES_NO_CODES),
        ("income_class", "income_class", INCOME_CODES),
    ),
    target_display="churn",
    analog={"age": "Ages", "frequent_buyer": "FrequentFlyer", "income_class": "AnnualIncomeClass",
            "services": "ServicesOpted", "has_urgent": "AccountSyncedToSocialMedia", "has_pending": "BookedHotelOrNot"},
)

# The reference's own 954-row table, with ``Ages`` renamed ``Age`` as its EDA does.
GOLDEN_SPEC = RoleSpec(
    key="row_id",
    target="Target",
    numeric=("Age", "ServicesOpted"),
    categorical=("FrequentFlyer", "AnnualIncomeClass", "AccountSyncedToSocialMedia", "BookedHotelOrNot"),
    age="Age",
    services="ServicesOpted",
    age_bins=BinSpec("Age", AGE_EDGES, AGE_LABELS, "AgeGroup"),
    service_bins=BinSpec("ServicesOpted", SERVICE_EDGES, SERVICE_LABELS, "ServicesGroup"),
    interactions=(("AnnualIncomeClass", "FrequentFlyer"), ("ServicesGroup", "BookedHotelOrNot")),
    corr_columns=(
        ("Age", "Age", None),
        ("ServicesOpted", "ServicesOpted", None),
        ("Churn", "Target", None),
        ("FrequentFlyer", "FrequentFlyer", FLYER_CODES),
        ("SocialMediaSync", "AccountSyncedToSocialMedia", YES_NO_CODES),
        ("BookedHotel", "BookedHotelOrNot", YES_NO_CODES),
        ("IncomeClass", "AnnualIncomeClass", INCOME_CODES),
    ),
    analog={"Age": "Ages"},
)

# The reference's prepared features (``Ages`` keeps its name there).
PREP_SPEC = RoleSpec(
    key="row_id",
    target="Target",
    numeric=("Ages", "ServicesOpted"),
    categorical=("FrequentFlyer", "AnnualIncomeClass", "AccountSyncedToSocialMedia", "BookedHotelOrNot"),
)

# The benchmark view ``line_returns``: one row per line item.
LINE_SPEC = RoleSpec(
    key="l_orderkey",
    target="target",
    numeric=("quantity", "discount"),
    categorical=("line_status", "supplier_region", "priority"),
    interactions=(("supplier_region", "priority"),),
)
