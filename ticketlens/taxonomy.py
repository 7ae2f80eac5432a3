"""The three-level label taxonomy, as a constant and as small tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.session import one_row

# Primary -> secondary -> tertiary labels.
TAXONOMY = {
    "Billing": {
        "Duplicate Charge": ["Subscription Upgrade Flow", "Payment Method Update", "Promo Code Applied"],
        "Failed Payment": ["Credit Card Expired", "Insufficient Funds", "Bank Decline"],
        "Refund Request": ["Cancellation Refund", "Overcharge Refund", "Trial Extension"],
        "Invoice Question": ["Monthly Summary", "Annual Billing", "Tax Documentation"],
    },
    "Online Ordering": {
        "Page Not Loading": ["Checkout Flow", "Menu Display", "Mobile Browser"],
        "Menu Not Updating": ["Item Availability", "Price Sync", "Category Order"],
        "Order Not Received": ["Third-Party Integration", "Notification Failure", "POS Sync"],
        "Ordering Disabled": ["Account Suspension", "Setup Incomplete", "Integration Error"],
    },
    "Marketing / SEO": {
        "Google Listing Issue": ["GMB Sync", "Address Incorrect", "Hours Not Updating"],
        "Website Not Updating": ["Content Change", "Image Upload", "Domain Issue"],
        "SEO Performance": ["Ranking Drop", "Review Response", "Keyword Targeting"],
        "Campaign Not Running": ["Email Campaign", "SMS Campaign", "Ad Integration"],
    },
    "Product / Feature": {
        "Feature Not Working": ["Dashboard", "Notifications", "Reporting"],
        "Feature Request": ["Custom Branding", "Multi-Location", "API Access"],
        "Performance Issue": ["Slow Load Time", "Timeout Error", "Data Lag"],
        "Integration Issue": ["POS Integration", "Payment Gateway", "Third-Party App"],
    },
    "Account Access": {
        "Login Issue": ["SSO Failure", "Password Reset", "2FA Problem"],
        "Permissions Error": ["Staff Access", "Admin Role", "Read-Only Mode"],
        "Account Locked": ["Too Many Attempts", "Suspicious Activity", "Billing Hold"],
        "Account Setup": ["New User Invite", "Profile Incomplete", "Timezone Setting"],
    },
    "Onboarding": {
        "Setup Confusion": ["POS Connection", "Domain Setup", "Menu Import"],
        "Integration Help": ["Square Integration", "Toast Integration", "Clover Integration"],
        "Training Request": ["Dashboard Walkthrough", "Reporting Tutorial", "Campaign Setup"],
        "Go-Live Issue": ["Site Not Published", "Ordering Not Active", "Listing Not Live"],
    },
}

PRIMARY_LABELS = list(TAXONOMY)

#: Two-level form: what a labeller is told to choose from.
PAIRS_BY_PRIMARY = {primary: list(secondaries) for primary, secondaries in TAXONOMY.items()}


def taxonomy_pairs(spark: SparkSession) -> DataFrame:
    """24 rows ``(primary_label, secondary_label)``; its size is fixed, so it may be broadcast."""
    return (
        one_row(spark)
        .select(F.from_json(F.lit(json.dumps(PAIRS_BY_PRIMARY)), "map<string,array<string>>").alias("tree"))
        .select(F.explode("tree").alias("primary_label", "children"))
        .select("primary_label", F.explode("children").alias("secondary_label"))
    )


def taxonomy_leaves(spark: SparkSession) -> DataFrame:
    """72 rows ``(primary_label, secondary_label, tertiary_label)``; fixed size."""
    return (
        one_row(spark)
        .select(F.from_json(F.lit(json.dumps(TAXONOMY)), "map<string,map<string,array<string>>>").alias("tree"))
        .select(F.explode("tree").alias("primary_label", "children"))
        .select("primary_label", F.explode("children").alias("secondary_label", "leaves"))
        .select("primary_label", "secondary_label", F.explode("leaves").alias("tertiary_label"))
    )
