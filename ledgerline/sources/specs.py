"""Business tables, their roles and the constants decisions are made with."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ----------------------------------------------------------------------------------------------
# Business assumptions, band edges and labels results depend on.
# ----------------------------------------------------------------------------------------------
RATIO_FLOOR = 1e-9
DISCOUNT_RATE = 0.12
NPV_HORIZON_YEARS = 3
FUND_THRESHOLD = 0.0
REVIEW_BAND = (-10.0, 0.0)
HIGH_RISK_PENALTY = 1.5
LGD = 0.40
APPROVE_PD = 0.05
REJECT_PD = 0.30
MAX_ECL_RATIO = 0.12
UPGRADE_COVERAGE = 1.5
PD_BAND_EDGES = [0.0, 0.05, 0.15, 0.30]
PD_BAND_LABELS = ["low", "medium", "high"]
PD_BAND_DEFAULT = "very_high"
COST_MISSED_FRAUD = 10000.0
COST_FALSE_POSITIVE = 500.0
THRESHOLD_POINTS = 501
CONTACT_BUDGET = 1000
CLV_HORIZON_YEARS = 3
CLV_RETENTION = 0.9
CLV_MARGIN = 0.3
EQUITY_HORIZON = 1
LONG_QUANTILE = 0.20
SHORT_QUANTILE = 0.20
TRANSACTION_COST_BPS = 10.0
RISK_FREE_RATE = 0.06
TRADING_DAYS = 252
LIQUIDITY_HORIZON = 5
STRESS_SCENARIOS = {"mild": (0.02, 0.10), "severe": (0.05, 0.25), "extreme": (0.10, 0.50)}
VAR_CONFIDENCE = (0.95, 0.99)
VAR_PATHS = 10000
TOTAL_CAPITAL_CRORE = 1000.0
CREDIT_BAND_EDGES = [0, 580, 670, 740, 800, 900]
CREDIT_BAND_LABELS = ["poor", "fair", "good", "very_good", "excellent"]
AGE_BAND_EDGES = [0, 30, 45, 60, 100]
AGE_BAND_LABELS = ["young", "mid", "senior", "retired"]
MATURITY_EDGES = [0, 0.25, 0.5, 1.0, 2.01]
MATURITY_LABELS = ["front", "near", "mid", "long"]
CONSTANT_CV = 0.01
IDENTITY_TOLERANCE = 0.05
ALIAS_CORRELATION = 0.95
MIN_AGREEMENT = 0.85
MAX_FOLD_SE = 0.05
WEAK_SIGNAL = 0.05
PRIMARY_METRIC = {
    "initiatives": ("pr_auc", True), "loans": ("ks", True), "transactions": ("pr_auc", True),
    "customers": ("pr_auc", True), "customers_clv": ("rmse", False), "market": ("mean_ic", True),
    "liquidity": ("mae", False), "options": ("rmse", False), "hft": ("macro_f1", True),
}
DEFAULT_PRIMARY_METRIC = ("roc_auc", True)
HEADLINE_METRICS = {
    "binary_classification": ["roc_auc", "pr_auc", "brier"],
    "multiclass_classification": ["macro_f1", "balanced_accuracy"],
    "regression": ["rmse", "mae", "r2"],
    "panel_regression": ["mean_ic", "ic_ir"],
    "time_series_forecast": ["mae", "rmse"],
}
#: bucket, expected return, volatility, loss rate, lowest share, highest share, capacity in crore
BUCKET_DEFAULTS = [
    ("corporate_lending", 0.104, 0.045, 0.040, 0.10, 0.30, None),
    ("retail_lending", 0.112, 0.038, 0.046, 0.10, 0.30, None),
    ("digital_banking", 0.095, 0.055, 0.008, 0.05, 0.25, None),
    ("wealth_management", 0.088, 0.030, 0.004, 0.05, 0.20, None),
    ("equity_investments", 0.128, 0.165, 0.0, 0.05, 0.20, None),
    ("high_frequency_trading", 0.180, 0.120, 0.0, 0.0, 0.05, 50.0),
    ("derivatives_hedging", -0.020, 0.010, 0.0, 0.02, 0.10, None),
    ("liquidity_reserve", 0.055, 0.005, 0.0, 0.10, 0.25, None),
]


# ----------------------------------------------------------------------------------------------
# Table contracts
# ----------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class TableSpec:
    """Roles of a table's columns; the schema is fixed, never inferred."""

    key: str
    task: str
    target: str
    schema: T.StructType | None = None
    id_columns: tuple[str, ...] = ()
    datetime_columns: tuple[str, ...] = ()
    categorical_columns: tuple[str, ...] = ()
    drop_always: tuple[str, ...] = ()
    acknowledged_leaks: tuple[str, ...] = ()
    group_column: str | None = None
    other_targets: tuple[str, ...] = ()
    expected_rows: int | None = None
    expected_cols: int | None = None
    positive_rate: float | None = None
    datetime_formats: dict[str, str] = field(default_factory=dict)

    @property
    def forbidden_features(self) -> set[str]:
        """Columns that may never be model inputs, every declared target included."""
        out = {*self.drop_always, *self.id_columns, self.target, *self.other_targets}
        if self.group_column:
            out.add(self.group_column)
        return out

    def is_declared_leak(self, column: str) -> bool:
        return column in self.drop_always or column in self.acknowledged_leaks


def _schema(**columns: str) -> T.StructType:
    kinds = {
        "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(),
        "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(),
    }
    return T.StructType([T.StructField(n, kinds[t]) for n, t in columns.items()])


def _doubles(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "double")


# ----------------------------------------------------------------------------------------------
# The contracts of the business tables (columns, expected sizes and rates, roles).
# ----------------------------------------------------------------------------------------------
TABLES: dict[str, TableSpec] = {
    "initiatives": TableSpec(
        "initiatives", "binary_classification", "Historical_Success",
        _schema(Initiative_ID="string", Business_Unit="string", Risk_Rating="string", **_doubles(
            "Initial_Investment", "Revenue_Year1", "Revenue_Year2", "Revenue_Year3", "Operating_Cost",
            "Business_Growth", "GDP_Growth", "Expected_ROI", "Interest_Rate", "Competition_Index"),
            Historical_Success="int"),
        id_columns=("Initiative_ID",), categorical_columns=("Business_Unit", "Risk_Rating"),
        drop_always=("Initiative_ID",), expected_rows=180, expected_cols=14, positive_rate=0.7667,
    ),
    "loans": TableSpec(
        "loans", "binary_classification", "Default_Flag",
        _schema(Customer_ID="bigint", Customer_Type="string", Annual_Income="double", Loan_Amount="double",
                Collateral_Value="double", Existing_Loan="double", Interest_Rate="double", Loan_Term_Months="int",
                Credit_Score="int", Employment_Length="int", Debt_to_Income="double", Past_Default="int",
                Sector_Risk="double", Default_Flag="int"),
        id_columns=("Customer_ID",), categorical_columns=("Customer_Type",), drop_always=("Customer_ID",),
        expected_rows=5000, expected_cols=14, positive_rate=0.1994,
    ),
    "transactions": TableSpec(
        "transactions", "binary_classification", "Fraud_Flag",
        _schema(Transaction_ID="bigint", Timestamp="timestamp_ntz", Customer_ID="bigint", Device_ID="string",
                Amount="double", Transaction_Type="string", Merchant_Category="string", Location="string",
                Historical_Avg_Transaction="double", Account_Age_Months="int", Transaction_Frequency="double",
                Fraud_Flag="int"),
        id_columns=("Transaction_ID",), datetime_columns=("Timestamp",),
        categorical_columns=("Transaction_Type", "Merchant_Category", "Location"), drop_always=("Transaction_ID",),
        group_column="Customer_ID", expected_rows=30000, expected_cols=12, positive_rate=0.0228,
    ),
    "customers": TableSpec(
        "customers", "binary_classification", "Churn_Flag",
        _schema(Customer_ID="bigint", Age="int", Annual_Income="double", Account_Balance="double",
                Investment_Balance="double", Loan_Balance="double", Complaints="int",
                Relationship_Length_Years="double", Products_Held="int", Transactions_Per_Month="double",
                Digital_Usage="double", Estimated_CLV="double", Churn_Flag="int"),
        id_columns=("Customer_ID",), other_targets=("Estimated_CLV",),
        drop_always=("Customer_ID", "decision_value_rank", "decision_attrition_proxy", "decision_priority_score"),
        expected_rows=5000, expected_cols=13, positive_rate=0.0178,
    ),
    "market": TableSpec(
        "market", "panel_regression", "Return",
        _schema(Date="date", Ticker="string", Sector="string", Open="double", High="double", Low="double",
                Close="double", Volume="bigint", Return="double", Market_Return="double", GDP_Growth="double",
                Interest_Rate="double", VIX="double", Momentum_20D="double", Volatility_20D="double"),
        id_columns=("Ticker",), datetime_columns=("Date",), categorical_columns=("Ticker", "Sector"),
        drop_always=("Open", "High", "Low", "Close", "Return"), other_targets=("fwd_return_1d", "fwd_return_5d"),
        expected_rows=21855, expected_cols=15,
    ),
    "liquidity": TableSpec(
        "liquidity", "time_series_forecast", "Expected_Outflows",
        _schema(Date="date", **_doubles(
            "Deposits", "Loan_Disbursements", "Loan_Repayments", "Wholesale_Funding", "Cash", "Securities_Holdings",
            "Expected_Inflows", "Expected_Outflows", "Liquidity_Gap", "Liquidity_Buffer", "Market_Stress",
            "Interest_Rate")),
        datetime_columns=("Date",), drop_always=("Liquidity_Gap",),
        other_targets=("Liquidity_Gap", "fwd_outflows_5d", "fwd_inflows_5d"), expected_rows=1216, expected_cols=13,
    ),
    "options": TableSpec(
        "options", "regression", "Market_Price",
        _schema(Option_ID="string", Underlying="string", Option_Type="string", Expiry="date", **_doubles(
            "Spot", "Strike", "Time_to_Maturity", "Volatility", "Interest_Rate", "Market_Price",
            "Black_Scholes_Price")),
        id_columns=("Option_ID",), datetime_columns=("Expiry",), categorical_columns=("Underlying", "Option_Type"),
        drop_always=("Option_ID",), acknowledged_leaks=("Black_Scholes_Price",),
        other_targets=("mispricing", "mispricing_pct", "time_value", "bs_recomputed", "bs_check_error", "bs_check_error_pct"),
        expected_rows=10000, expected_cols=11,
    ),
    "hft": TableSpec(
        "hft", "multiclass_classification", "Price_Move_Class",
        None, datetime_columns=("Timestamp",), categorical_columns=("Stock", "Event_Type", "Trade_Side"),
        drop_always=("Future_Return_100ms", "Future_Price_100ms"), group_column="Trading_Day",
        expected_rows=120000, expected_cols=33,
        datetime_formats={"Timestamp": "dd-MM-yyyy HH:mm", "Trading_Day": "dd-MM-yyyy"},
    ),
}

#: The inputs the closed-form price uses itself.
PRIMITIVE_FEATURES = ["Spot", "Strike", "Time_to_Maturity", "Volatility", "Interest_Rate", "is_call"]
