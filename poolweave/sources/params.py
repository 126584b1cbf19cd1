"""Parameters of a run, from a text of `key = value` lines."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path

#: The keys of the text, and the field that each sets.
KEYS = {
    "In-pool_Gap_Support_Min": "in_pool_gap_min", "All-pool_Gap_Support_Min": "all_pool_gap_min", "Gap_Support_Step_Size": "gap_step",
    "Level_1_Region_Size_Min": "level_1_min", "Level_1_Region_Size_Max": "level_1_max", "Level_1_Last_Region_Min": "level_1_last",
    "Level_2_Region_Size_Min": "level_2_min", "Level_2_Region_Size_Max": "level_2_max", "Est_Ind_PerPool": "per_pool",
    "Regional_Global_Freq_Min": "regional_freq_min", "Regional_HapSetSize_Max": "min_keep", "Regional_HapSetSize_Min": "max_keep", "DC_HapSetSize_Rand": "random_share",
    "Iterations_AEM_Max": "em_rounds", "Difference_Cutoff": "em_tolerance", "Running_Freq_Min": "em_least", "Adhoc_Freq_Cutoff": "top_ties", "AEM_HapSetSize_Rand": "random_picks",
    "Fragments": "fragments", "FullLength_Local_Freq_Min": "local_freq_min", "Lambda_Penalty": "penalty", "Penalty_Step_Size": "penalty_step", "Minimum_R2_Fit": "least_r2",
    "One_Vector_Weight": "weight_one", "Hap_VC_Weight": "weight_site", "Hap_11_Weight": "weight_pair",
    "Input_Dir": "input_dir", "Intermediate_Dir": "work_dir", "Output_Dir": "output_dir", "Gold-Standard_Dir": "truth_dir",
}


@dataclass(frozen=True)
class Parameters:
    in_pool_gap_min: float = 0.5
    all_pool_gap_min: float = 0.5
    gap_step: float = 0.1
    level_1_min: int = 10
    level_1_max: int = 16
    level_1_last: int = 3
    level_2_min: int = 10
    level_2_max: int = 16
    per_pool: int = 1_000_000
    regional_freq_min: float = 0.05
    min_keep: int = 3
    max_keep: int = 50
    random_share: float = 0.2
    em_rounds: int = 150
    em_tolerance: float = 1e-5
    em_least: float = 4.88281e-7
    top_ties: int = 5
    random_picks: int = 10
    fragments: int = 1000
    local_freq_min: float = 0.005
    penalty: float = 0.25
    penalty_step: float = 0.04
    least_r2: float = 0.0
    weight_one: float = 1.0
    weight_site: float = 1.0
    weight_pair: float = 1.0
    input_dir: str = ""
    work_dir: str = ""
    output_dir: str = ""
    truth_dir: str = ""
    weighted_gaps: bool = False  # gap support over copies instead of rows; set by the caller of a run


def parse(text: str) -> Parameters:
    """Unknown keys are ignored; a value that does not fit its field raises."""
    kinds = {f.name: type(f.default) for f in fields(Parameters)}
    found = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!" and "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            if name := KEYS.get(key):
                found[name] = kinds[name](float(value)) if kinds[name] is int else kinds[name](value)
    return replace(Parameters(), **found)


def load(path: str) -> Parameters:
    return parse(Path(path).read_text())
