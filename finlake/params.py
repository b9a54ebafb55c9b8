"""Run parameters for the canonical views over the driver's test tables (FIXTURES.md section 3).

Every operator takes ``as_of`` and friends explicitly; these are the defaults used by the
registered queries, the oracle SQL and the tests. Nothing reads the wall clock.
"""

AS_OF = "1998-07-01"
OPENING_CUTOFF = "1996-12-31"      # latest uploaded balance sheet (opening journal date)
STOCK_CUTOFF = "1997-12-31"        # inventory count date
GST_REGISTERED = True
COMPANY = "default"
INCOME_TAX_RATE = 25.0
FORECAST_DAYS = 90
CURRENCY = "AUD"

# Supplier-invoice description phrase by ``l_partkey % 10`` (chosen so the default rules fire
# with a spread of priorities, capital items and a no-match case).
DESCRIPTION_PHRASES = (
    "freight charge",
    "office stationery",
    "software subscription",
    "electricity usage",
    "google ads campaign",
    "equipment hire",
    "restaurant meals",
    "general supplies",
    "facebook advertising",
    "email marketing",
)

# Receipt wording on bank rows by ``o_custkey % 4``
BANK_SEGMENT_PHRASES = ("key account", "healthcare", "commercial", "retail")

# Uploaded file names by ``doc_id % 17`` (one per routable document type)
UPLOAD_FILE_STEMS = (
    "balance_sheet", "profit_and_loss", "cash_flow_statement", "chart_of_accounts", "business_requirements",
    "fixed_asset_register", "aged_debtors", "material_contract", "sales_forecast", "personnel_plan",
    "user_stories", "tax_returns", "market_context", "bank_statement", "payroll_report", "sales_invoices",
    "supplier_invoices",
)
UPLOAD_STATUSES = ("committed", "stored_source", "failed", "pending_mapping", "stale")

DEPARTMENTS = ("Operations", "Sales", "Finance", "People")
SIGNAL_TYPES = ("competitor liquidity", "gross margin", "revenue growth", "cash runway")
STOCK_COUNT_FILE = "stock_count_31Dec1997.xlsx"

# Evaluation date for the upload registry (its files are dated during 2024)
REGISTRY_AS_OF = "2025-01-01"
