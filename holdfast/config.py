"""Control-plane descriptions of the three industries.  No table data lives here."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Industry:
    key: str
    name: str
    description: str
    target: str
    target_map: dict[str, int] | None = field(hash=False)
    drop_cols: tuple[str, ...]
    dimensions: tuple[str, ...]
    histogram: str
    kpi: tuple[str, int]
    segment_features: tuple[str, ...]
    monthly_revenue: float
    lifetime_months: int
    defaults: dict[str, object] = field(default_factory=dict, hash=False, compare=False)


# Column names, label maps and record defaults of the three input tables.
TELECOM = Industry(
    key="telecom",
    name="Telecom",
    description="Subscribers who may cancel their subscription",
    target="Churn",
    target_map={"Yes": 1, "No": 0},
    drop_cols=("customerID",),
    dimensions=("Contract", "InternetService"),
    histogram="tenure",
    kpi=("MonthlyCharges", 2),
    segment_features=("tenure", "MonthlyCharges", "TotalCharges"),
    monthly_revenue=65.0,
    lifetime_months=24,
    defaults={
        "tenure": 12.0,
        "MonthlyCharges": 65.0,
        "TotalCharges": 780.0,
        "gender": "Male",
        "SeniorCitizen": 0,
        "Partner": "Yes",
        "Dependents": "No",
        "PhoneService": "Yes",
        "MultipleLines": "No",
        "InternetService": "DSL",
        "Contract": "Month-to-month",
        "PaperlessBilling": "Yes",
        "PaymentMethod": "Electronic check",
    },
)

BANKING = Industry(
    key="banking",
    name="Banking",
    description="Bank clients who may close their account",
    target="Exited",
    target_map=None,
    drop_cols=("RowNumber", "CustomerId", "Surname"),
    dimensions=("Geography", "NumOfProducts"),
    histogram="Age",
    kpi=("Balance", 2),
    segment_features=("CreditScore", "Age", "Balance", "EstimatedSalary", "Tenure"),
    monthly_revenue=150.0,
    lifetime_months=36,
    defaults={
        "CreditScore": 650.0,
        "Geography": "France",
        "Gender": "Male",
        "Age": 35.0,
        "Tenure": 3.0,
        "Balance": 50000.0,
        "NumOfProducts": 1,
        "HasCrCard": 1,
        "IsActiveMember": 1,
        "EstimatedSalary": 60000.0,
    },
)

ECOMMERCE = Industry(
    key="ecommerce",
    name="E-Commerce",
    description="Online shoppers who may stop buying",
    target="Churn",
    target_map=None,
    drop_cols=("CustomerID",),
    dimensions=("PreferredLoginDevice", "SatisfactionScore", "Complain"),
    histogram="Tenure",
    kpi=("SatisfactionScore", 1),
    segment_features=("Tenure", "SatisfactionScore", "OrderCount", "CashbackAmount"),
    monthly_revenue=45.0,
    lifetime_months=18,
    defaults={
        "Tenure": 6.0,
        "PreferredLoginDevice": "Mobile Phone",
        "CityTier": 1,
        "WarehouseToHome": 20.0,
        "PreferredPaymentMode": "Debit Card",
        "Gender": "Male",
        "HourSpendOnApp": 3.0,
        "NumberOfDeviceRegistered": 3,
        "PreferedOrderCat": "Mobile Phone",
        "SatisfactionScore": 3,
        "MaritalStatus": "Single",
        "NumberOfAddress": 3,
        "Complain": 0,
        "OrderAmountHikeFromlastYear": 15.0,
        "CouponUsed": 2.0,
        "OrderCount": 3.0,
        "DaySinceLastOrder": 5.0,
        "CashbackAmount": 150.0,
    },
)

INDUSTRIES: dict[str, Industry] = {i.key: i for i in (TELECOM, BANKING, ECOMMERCE)}

# Revenue model defaults.
RETENTION_COST = 25.0
SUCCESS_RATE_PCT = 30

# Risk cut-offs (strict) and labels.
HIGH_RISK = 0.65
MEDIUM_RISK = 0.40
RISK_LABELS = ("High Risk", "Medium Risk", "Low Risk")
RISK_SHORT = ("High", "Medium", "Low")

# Segment names in order of falling churn rate.
SEGMENT_NAMES = (
    "High Risk — Immediate Action",
    "Medium Risk — Monitor Closely",
    "Low Risk — Stable",
    "Very Low Risk — Loyal Champions",
    "Undecided — Needs Analysis",
    "New — Too Early to Tell",
)
