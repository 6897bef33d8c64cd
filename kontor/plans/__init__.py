"""Physical-plan helpers: size-aware joins, blocked running totals and
finite-state scans, the checkpoint location."""

from kontor.plans.joins import join_small  # noqa: F401
from kontor.plans.lineage import checkpoint_dir, cut_lineage  # noqa: F401
from kontor.plans.prefix import running_total  # noqa: F401
from kontor.plans.fsm import fsm_scan  # noqa: F401
