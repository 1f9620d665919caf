"""Column roles as data: one ``CleaningSpec`` per cleaning variant instead of one code path per script."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CleaningSpec:
    """Column roles of one cleaning variant.

    ``numeric`` columns are mean-filled, ``nominal`` columns mode-filled, ``special`` columns zero-filled,
    ``targets`` are carried through untouched unless a rule fills them.
    """

    name: str
    id_col: str = "PatientId"
    numeric: tuple[str, ...] = ()
    nominal: tuple[str, ...] = ()
    special: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    order_col: str = "row_seq"
    gender_col: str = "PatientGender"
    height_col: str = "bmdtest_height"
    weight_col: str = "bmdtest_weight"

    @property
    def columns(self) -> list[str]:
        return [self.id_col, *self.numeric, *self.nominal, *self.special, *self.targets]


# Fixed column lists of the cleaning variants (values must equal the reference's).
NUMERIC_4 = ("PatientAge", "bmdtest_height", "bmdtest_weight", "bmdtest_tscore_fn")
NOMINAL_8 = ("PatientGender", "parentbreak", "ptunsteady", "alcohol", "wasfractdue2fall", "ptfall", "oralster", "smoke")
NOMINAL_13 = ("PatientGender", "parentbreak", "ptunsteady", "whereliv", "education", "alcohol", "wasfractdue2fall",
              "ptfall", "fxworried", "notworking", "marital", "oralster", "smoke")
SPECIAL_15 = ("arthritis", "cancer", "diabetes", "heartdisease", "respdisease", "howbreak", "hip", "ankle", "clavicle",
              "elbow", "femur", "spine", "wrist", "shoulder", "tibfib")
SPECIAL_CAROC = ("arthritis", "cancer", "diabetes", "heartdisease", "respdisease", "howbreak", "obreak", "hbp",
                 "cholesterol", "hip", "ankle", "clavicle", "elbow", "femur", "spine", "wrist", "shoulder", "tibfib")
NOMINAL_FRAX = ("PatientGender", "parentbreak", "alcohol", "oralster", "smoke")
SPECIAL_FRAX = ("arthritis", "diabetes", "obreak")

RAW = CleaningSpec("raw", numeric=NUMERIC_4, nominal=NOMINAL_13, special=SPECIAL_15)
MAIN = CleaningSpec("main", numeric=NUMERIC_4, nominal=NOMINAL_8, special=SPECIAL_15)
OLD = CleaningSpec("old", numeric=NUMERIC_4, nominal=NOMINAL_13, special=SPECIAL_15)
CAROC = CleaningSpec("caroc", numeric=NUMERIC_4, nominal=NOMINAL_8, special=SPECIAL_CAROC,
                     targets=("bmdtest_10yr_caroc",))
FRAX_WEB = CleaningSpec("frax_web", numeric=NUMERIC_4[:3], nominal=NOMINAL_FRAX, special=SPECIAL_FRAX,
                        targets=("FraxRiskLevel",))
FRAX_DLL = CleaningSpec("frax_dll", numeric=NUMERIC_4, nominal=NOMINAL_FRAX, special=SPECIAL_FRAX,
                        targets=("CalcFraxWithBMD", "CalcFraxNoBMD"))

SPECS = {s.name: s for s in (RAW, MAIN, OLD, CAROC, FRAX_WEB, FRAX_DLL)}


@dataclass(frozen=True)
class CohortSpec:
    """A training cohort: a row filter (column == value, or none for the control) and its feature list."""

    name: str
    features: tuple[str, ...]
    filter_col: str | None = None
    filter_value: int | None = None


# feature lists of the T-score networks per cohort (fixed values)
CONTROL_FEATURES = ("PatientAge", "PatientGender", "bmdtest_weight", "bmdtest_height", "shoulder", "wrist",
                    "heartdisease", "diabetes", "arthritis", "respdisease", "smoke")
COHORTS = (
    CohortSpec("control", CONTROL_FEATURES),
    CohortSpec("wrist", tuple(f for f in CONTROL_FEATURES if f not in ("shoulder", "wrist")), "wrist", 1),
    CohortSpec("shoulder", tuple(f for f in CONTROL_FEATURES if f not in ("shoulder", "wrist")), "shoulder", 1),
    CohortSpec("male", tuple(f for f in CONTROL_FEATURES if f != "PatientGender"), "PatientGender", 2),
    CohortSpec("female", tuple(f for f in CONTROL_FEATURES if f != "PatientGender"), "PatientGender", 1),
)
