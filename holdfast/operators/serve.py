"""Model-ready features for tables of customer records with named fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BANKING, ECOMMERCE, TELECOM
from ..functions.text import format_money, ref
from .clean import TELECOM_MAPS, apply_defaults, mapped
from .encode import SERVICES

# Encoded levels of each text field, in the order of the feature contract.
TELECOM_LEVELS = {
    "InternetService": ("Fiber optic", "No"),
    "Contract": ("One year", "Two year"),
    "PaymentMethod": ("Electronic check", "Mailed check", "Credit card (automatic)"),
}
BANKING_NUMBERS = ("CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember", "EstimatedSalary")
BANKING_LEVELS = {"Geography": ("Germany", "Spain"), "Gender": ("Male",)}
ECOMMERCE_NUMBERS = (
    "Tenure",
    "CityTier",
    "WarehouseToHome",
    "HourSpendOnApp",
    "NumberOfDeviceRegistered",
    "SatisfactionScore",
    "NumberOfAddress",
    "Complain",
    "OrderAmountHikeFromlastYear",
    "CouponUsed",
    "OrderCount",
    "DaySinceLastOrder",
    "CashbackAmount",
)
ECOMMERCE_LEVELS = {
    "PreferredLoginDevice": ("Mobile Phone", "Phone"),
    "PreferredPaymentMode": ("Credit Card", "Debit Card", "E wallet", "UPI", "Cash on Delivery"),
    "Gender": ("Male",),
    "PreferedOrderCat": ("Grocery", "Laptop & Accessory", "Mobile", "Mobile Phone", "Others"),
    "MaritalStatus": ("Married", "Single"),
}


def derive_total(monthly: Column, tenure: Column) -> Column:
    return monthly.cast("double") * tenure.cast("double")


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def _dummies(fields: dict[str, Sequence[str]]) -> dict[str, Column]:
    return {f"{field}_{lvl}": _flag(ref(field) == F.lit(lvl)) for field, levels in fields.items() for lvl in levels}


def feat_telecom(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Thirty numeric features.  Service columns are used when the record has them; otherwise they are 0."""
    present = set(df.columns)
    rec = apply_defaults(df, TELECOM.defaults)
    out: dict[str, Column] = {
        c: F.coalesce(mapped(ref(c), TELECOM_MAPS[c]), F.lit(0)).cast("double") for c in TELECOM_MAPS
    }
    for c in ("SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"):
        out[c] = ref(c).cast("double")
    out.update(_dummies(TELECOM_LEVELS))
    offline = _flag(ref("InternetService") == "No")
    for s in SERVICES:
        given = s in present
        out[f"{s}_No internet service"] = F.when(ref(s).isNotNull(), _flag(ref(s) == "No internet service")).otherwise(offline) if given else offline
        out[f"{s}_Yes"] = _flag(ref(s) == "Yes") if given else F.lit(0.0)
    total = F.lit(0.0)
    for s in SERVICES:
        total = total + out[f"{s}_Yes"]
    out["total_services"] = total
    return rec.select(*[ref(k) for k in keep], *[c.alias(n) for n, c in out.items()])


def feat_banking(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    rec = apply_defaults(df, BANKING.defaults)
    out = {c: ref(c).cast("double") for c in BANKING_NUMBERS} | _dummies(BANKING_LEVELS)
    return rec.select(*[ref(k) for k in keep], *[c.alias(n) for n, c in out.items()])


def feat_ecommerce(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    rec = apply_defaults(df, ECOMMERCE.defaults)
    out = {c: ref(c).cast("double") for c in ECOMMERCE_NUMBERS} | _dummies(ECOMMERCE_LEVELS)
    return rec.select(*[ref(k) for k in keep], *[c.alias(n) for n, c in out.items()])


def senior_flag(age: Column) -> Column:
    return F.when(age >= 60, "Yes").when(age < 60, "No")


def display_record(df: DataFrame, industry: str) -> DataFrame:
    """The common text fields under which unlike customer records are logged and shown."""
    yes = F.lit("Yes")
    if industry == "telecom":
        fields = {
            "tenure": F.concat(ref("tenure").cast("int").cast("string"), F.lit(" months")),
            "monthly_charges": F.concat(F.lit("$"), F.format_number(ref("MonthlyCharges").cast("double"), 0)),
            "contract": ref("Contract"),
            "internet": ref("InternetService"),
            "payment": ref("PaymentMethod"),
            "senior": F.when(ref("SeniorCitizen") == 1, "Yes").otherwise("No"),
            "partner": ref("Partner"),
            "tech_support": ref("TechSupport"),
            "paperless": ref("PaperlessBilling"),
        }
    elif industry == "banking":
        fields = {
            "tenure": F.concat(ref("Tenure").cast("int").cast("string"), F.lit(" years")),
            "monthly_charges": F.concat(
                F.lit("$"), F.replace(F.format_number(ref("EstimatedSalary") / 12, 0), F.lit(","), F.lit("")), F.lit("/month")
            ),
            "contract": F.concat(ref("NumOfProducts").cast("string"), F.lit(" product(s)")),
            "internet": ref("Geography"),
            "payment": ref("Gender"),
            "senior": senior_flag(ref("Age")),
            "partner": F.concat(F.lit("Balance "), format_money(ref("Balance"))),
            "tech_support": F.when(ref("IsActiveMember") == 1, "Active").otherwise("Inactive"),
            "paperless": F.when(ref("HasCrCard") == 1, "Yes").otherwise("No"),
        }
    elif industry == "ecommerce":
        fields = {
            "tenure": F.concat(ref("Tenure").cast("int").cast("string"), F.lit(" months")),
            "monthly_charges": F.concat(
                F.lit("Cashback $"), F.replace(F.format_number(ref("CashbackAmount"), 0), F.lit(","), F.lit(""))
            ),
            "contract": ref("PreferredLoginDevice"),
            "internet": ref("PreferedOrderCat"),
            "payment": ref("PreferredPaymentMode"),
            "senior": F.lit("No"),
            "partner": ref("MaritalStatus"),
            "tech_support": F.when(ref("Complain") == 1, "No").otherwise("Yes"),
            "paperless": yes,
        }
    else:
        raise ValueError(f"unknown industry {industry!r}")
    return df.withColumn("display", F.struct(*[c.alias(n) for n, c in fields.items()]))
