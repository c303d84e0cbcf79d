"""Default thresholds, windows and tenant feature declarations.

Every value is only a default: operators take them as parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: behavioural constants of the monitored platform -----------
PSI_STABLE = 0.10
PSI_MODERATE = 0.25
PSI_ZERO_SHARE = 1e-4
MIN_DRIFT_SAMPLES = 30
NUM_QUANTILE_BINS = 10
MIN_ACCURACY_SAMPLES = 30
F1_DROP = 0.15
LOOKBACK_HOURS = 24
DEPLOY_WINDOW_MINUTES = 30
UPSTREAM_WINDOW_MINUTES = 30
FORWARD_TOLERANCE_MINUTES = 5
DEDUP_MINUTES = 15
AUTO_REMEDIATE_CONFIDENCE = 0.80
MIN_RETRAIN_SAMPLES = 100
GATE_MARGIN = 0.01
CANARY_SHARE_PERCENT = 10.0
MIN_CANARY_PREDICTIONS = 50
HOLDOUT_FRACTION = 0.15
TEST_FRACTION = 0.20
TOKEN_PRICE_IN_PER_MILLION = 0.59
TOKEN_PRICE_OUT_PER_MILLION = 0.79
DEFAULT_MODEL_NAMES = ("churn-model", "fraud-model")
DEFAULT_DELAY_MULTIPLIER = 10.0
DEFAULT_SKEW_PROBABILITY = 0.8


@dataclass(frozen=True)
class Tenant:
    """What one monitored model expects in a feature payload."""

    name: str
    id_column: str
    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    labels: tuple[str, str] = ("negative", "positive")

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


# --- fixed values: tenant schemas and their category domains ------------------
_YES_NO = ("Yes", "No")
_INTERNET_ADDON = ("Yes", "No", "No internet service")

CHURN = Tenant(
    name="churn-model",
    id_column="customerID",
    target="Churn",
    numeric=("tenure", "MonthlyCharges", "TotalCharges"),
    categorical=(
        "gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService",
        "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
        "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
        "Contract", "PaperlessBilling", "PaymentMethod",
    ),
    domains={
        "gender": ("Male", "Female"),
        "SeniorCitizen": ("0", "1"),
        "Partner": _YES_NO,
        "Dependents": _YES_NO,
        "PhoneService": _YES_NO,
        "MultipleLines": ("Yes", "No", "No phone service"),
        "InternetService": ("DSL", "Fiber optic", "No"),
        "OnlineSecurity": _INTERNET_ADDON,
        "OnlineBackup": _INTERNET_ADDON,
        "DeviceProtection": _INTERNET_ADDON,
        "TechSupport": _INTERNET_ADDON,
        "StreamingTV": _INTERNET_ADDON,
        "StreamingMovies": _INTERNET_ADDON,
        "Contract": ("Month-to-month", "One year", "Two year"),
        "PaperlessBilling": _YES_NO,
        "PaymentMethod": (
            "Electronic check", "Mailed check",
            "Bank transfer (automatic)", "Credit card (automatic)",
        ),
    },
    labels=("No Churn", "Churn"),
)

FRAUD = Tenant(
    name="fraud-model",
    id_column="transaction_id",
    target="is_fraud",
    numeric=(
        "transaction_amount", "location_distance_km",
        "account_age_days", "velocity_1h_count",
    ),
    categorical=(
        "merchant_category", "device_type", "is_international", "is_flagged_ip",
    ),
    domains={
        "merchant_category": ("retail", "travel", "gaming", "crypto", "electronics"),
        "device_type": ("mobile_ios", "mobile_android", "web_desktop"),
        "is_international": ("0", "1"),
        "is_flagged_ip": ("0", "1"),
    },
    labels=("Legitimate", "Fraud"),
)

# The opening words of each cause, by which readers recognise it, and the truncation mark.
BAD_DEPLOYMENT = "Bad deployment"
UPSTREAM_FAILURE = "Upstream data pipeline failure"
SINGLE_DRIFT = "Isolated single-feature input drift"
BROAD_DRIFT = "Broad concept drift"
UNCLEAR_CAUSE = "Unclear root cause"
ROLLBACK_IMPOSSIBLE = "Rollback impossible"
TRUNCATED = "(truncated)"
