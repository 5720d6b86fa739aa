"""Fixed values and parameter records.

Everything the jobs can be told is a field here; every field has the default
of the published study.
"""

from __future__ import annotations

from dataclasses import dataclass

# Names, codes, costs and model settings that the results depend
# on. Kept together, in natural order.
LABEL = "main_label"
ID_COLUMNS = ("num", "company", "industry", "link", "emis_id")
COUNTRY_NAMES = {
    0: "CZ (Czech Republic)",
    1: "HU (Hungary)",
    2: "PL (Poland)",
    3: "SK (Slovakia)",
}
SECTOR_NAMES = {
    1: "Construction (NAICS 23)",
    2: "Manufacturing (NAICS 31-33)",
    3: "Retail Trade (NAICS 44)",
    4: "Wholesale Trade (NAICS 42)",
    5: "Transportation & Warehousing (NAICS 48)",
    6: "Utilities (NAICS 22)",
}
LABEL_NAMES = {0: "healthy", 1: "distressed"}
TRAIN_SHARE = 0.8
SPLIT_YEAR = 2017
MIN_COVERAGE = 0.05
SEED = 42
PCA_COMPONENTS = 50
# End of the fixed values.


@dataclass(frozen=True)
class Roles:
    """Which columns of an observation table mean what."""

    label: str = LABEL
    ids: tuple[str, ...] = ID_COLUMNS
    year: str = "year"
    country: str = "country"
    sector: str = "sector_1"


@dataclass(frozen=True)
class Costs:
    """Worth of one row of each confusion cell, for the utility metric."""

    tp: float = 1.0
    tn: float = 0.0
    fp: float = -1.0
    fn: float = -10.0


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 100
    depth: int = 10
    min_rows_per_leaf: int = 10
    features_per_split: str = "sqrt"
    seed: int = SEED
    # Node statistics gathered per pass over the data. This holds the deepest
    # level of all trees at once, so each level costs one pass.
    memory_mb: int = 512
    # Whether to remember the node each row has reached: 4 bytes per row and tree.
    cache_node_ids: bool = True
    # Rows of a partition of the train rows, about, and the least number of
    # partitions. Bootstraps are drawn per partition, so the forest depends on the
    # rows and these two numbers, and on nothing of the cluster.
    partition_rows: int = 50_000
    least_partitions: int = 8

    def partitions(self, rows: int) -> int:
        """Partitions of so many train rows."""
        return max(self.least_partitions, -(-rows // self.partition_rows))


@dataclass(frozen=True)
class Experiment:
    name: str
    short_name: str
    scale: bool
    pca: bool


# The four experiments, in reporting order.
EXPERIMENTS = (
    Experiment("Baseline (no scaling, no PCA)", "Baseline", scale=False, pca=False),
    Experiment("StandardScaler only (no PCA)", "Scaled", scale=True, pca=False),
    Experiment("PCA only (scaled internally)", "PCA Only", scale=False, pca=True),
    Experiment("StandardScaler + PCA", "Scaled+PCA", scale=True, pca=True),
)
