"""Metric mapping tables (FLT-23, KPI-16): fixed values that must match the sources' own
labels. Each list is in order of priority."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Reporting concepts per metric, first tagged concept wins.
INCOME_CONCEPTS = {
    "pretax_income": ["IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
                      "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments"],
    "income_tax": ["IncomeTaxExpenseBenefit", "CurrentIncomeTaxExpenseBenefit"],
    "interest_expense": ["InterestExpense", "InterestExpenseDebt"],
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax",
                "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet", "SalesRevenueGoodsNet"],
    "gross_profit": ["GrossProfit"],
    "cost_of_revenue": ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfServices",
                        "CostOfGoodsAndServiceExcludingDepreciationDepletionAndAmortization"],
    "operating_income": ["OperatingIncomeLoss"],
    "net_income": ["NetIncomeLoss"],
    "rd_expense": ["ResearchAndDevelopmentExpense", "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost"],
    "sga_expense": ["SellingGeneralAndAdministrativeExpense"],
    "selling_marketing_expense": ["SellingAndMarketingExpense"],
    "general_admin_expense": ["GeneralAndAdministrativeExpense"],
}
SHARE_CONCEPTS = {"diluted_shares": ["WeightedAverageNumberOfDilutedSharesOutstanding",
                                     "WeightedAverageNumberOfShareOutstandingBasicAndDiluted",
                                     "WeightedAverageNumberOfSharesOutstandingBasic"]}
EPS_CONCEPTS = {"diluted_eps": ["EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted",
                                "IncomeLossFromContinuingOperationsPerDilutedShare"]}
CASH_FLOW_CONCEPTS = {
    "operating_cf": ["NetCashProvidedByUsedInOperatingActivities"],
    "cash_dividends_paid": ["PaymentsOfDividendsCommonStock", "PaymentsOfDividends", "PaymentsOfOrdinaryDividends"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets",
              "PaymentsToAcquireMachineryAndEquipment", "PurchaseOfPropertyPlantAndEquipment"],
}
BALANCE_CONCEPTS = {
    "current_assets": ["AssetsCurrent"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "retained_earnings": ["RetainedEarningsAccumulatedDeficit"],
    "minority_interest": ["MinorityInterest"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue", "Cash"],
    "cash_and_st_investments": ["CashCashEquivalentsAndShortTermInvestments"],
    "debt_total_legacy": ["LongTermDebt", "LongTermDebtAndCapitalLeaseObligations", "ConvertibleDebt",
                          "ConvertibleNotesPayable", "NotesPayable", "LoansPayable"],
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "accounts_payable": ["AccountsPayableCurrent", "AccountsPayableTradeCurrent",
                         "AccountsPayableAndAccruedLiabilitiesCurrent"],
    "accrued_liabilities": ["AccruedLiabilitiesCurrent"],
    "deferred_revenue": ["ContractWithCustomerLiabilityCurrent", "DeferredRevenueCurrent"],
    "lease_liabilities": ["OperatingLeaseLiabilityNoncurrent", "OperatingLeaseLiability",
                          "FinanceLeaseLiabilityNoncurrent"],
    "stockholders_equity": ["StockholdersEquity",
                            "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "goodwill": ["Goodwill"],
    "ppe_net": ["PropertyPlantAndEquipmentNet"],
    "inventory": ["InventoryNet"],
    "intangibles": ["IntangibleAssetsNetExcludingGoodwill", "FiniteLivedIntangibleAssetsNet",
                    "IntangibleAssetsNetIncludingGoodwill"],
}
# Metrics tagged either as one total or as several groups of alternatives;
# an authoritative metric is never marked partial.
COMPOSITES = {
    "short_term_debt": {"total": ["DebtCurrent"], "parts": [
        ["ShortTermBorrowings", "LoansPayableCurrent", "SecuredDebtCurrent", "ShortTermBankLoansAndNotesPayable"],
        ["LongTermDebtCurrent", "LongTermDebtAndCapitalLeaseObligationsCurrent"],
        ["ConvertibleDebtCurrent", "ConvertibleNotesPayableCurrent"]]},
    "long_term_debt": {"total": [], "parts": [
        ["LongTermDebtNoncurrent", "LongTermDebtAndCapitalLeaseObligationsNoncurrent", "LongTermNotesPayable",
         "LongTermLoansPayable", "SecuredLongTermDebt"],
        ["ConvertibleDebtNoncurrent", "ConvertibleLongTermNotesPayable"],
        ["UnsecuredLongTermDebt", "SeniorLongTermNotes", "SeniorNotes"]]},
    "receivables": {"total": ["ReceivablesNetCurrent"], "parts": [
        ["AccountsReceivableNetCurrent"], ["OtherReceivablesNetCurrent", "OtherReceivables"],
        ["DueFromRelatedPartiesCurrent"], ["InterestReceivableCurrent"],
        ["LoansAndLeasesReceivableNetReportedAmount", "NotesReceivableNet"]]},
    "short_term_investments": {"total": [], "parts": [
        ["ShortTermInvestments", "MarketableSecuritiesCurrent", "AvailableForSaleSecuritiesDebtSecuritiesCurrent",
         "HeldToMaturitySecuritiesCurrent", "OtherShortTermInvestments"],
        ["TimeDepositsAtCarryingValue", "BankTimeDeposits"]]},
    "restricted_cash": {"total": ["RestrictedCashAndCashEquivalentsAtCarryingValue",
                                  "RestrictedCashCurrentAndNoncurrent"],
                        "parts": [["RestrictedCashCurrent"], ["RestrictedCashNoncurrent"]], "authoritative": True},
    "long_term_investments": {"total": ["LongTermInvestments"], "parts": [
        ["EquityMethodInvestments"], ["EquitySecuritiesWithoutReadilyDeterminableFairValueAmount"],
        ["EquitySecuritiesFvNiNoncurrent"],
        ["AvailableForSaleSecuritiesDebtSecuritiesNoncurrent", "MarketableSecuritiesNoncurrent"],
        ["HeldToMaturitySecuritiesNoncurrent"], ["OtherLongTermInvestments"]]},
}
# Aggregates whose tagged value can only under-count.
PARTIAL_METRICS = ["intangibles", "accounts_payable"]

# Labels of the wide statement frames.
FRAME_LABELS = {
    "pretax_income": ["Pretax Income"],
    "income_tax": ["Tax Provision", "Income Tax Expense Benefit"],
    "ebitda": ["Normalized EBITDA", "EBITDA"],
    "interest_expense": ["Interest Expense", "Interest Expense Non Operating"],
    "revenue": ["Total Revenue", "Operating Revenue"],
    "cost_of_revenue": ["Cost Of Revenue", "Reconciled Cost Of Revenue"],
    "gross_profit": ["Gross Profit"],
    "operating_income": ["Operating Income", "Total Operating Income As Reported"],
    "net_income": ["Net Income", "Net Income Common Stockholders", "Net Income Continuous Operations"],
    "diluted_eps": ["Diluted EPS", "Basic EPS"],
    "diluted_shares": ["Diluted Average Shares", "Basic Average Shares"],
    "rd_expense": ["Research And Development"],
    "sga_expense": ["Selling General And Administration"],
    "selling_marketing_expense": ["Selling And Marketing Expense"],
    "general_admin_expense": ["General And Administrative Expense"],
    "current_assets": ["Current Assets"],
    "current_liabilities": ["Current Liabilities"],
    "retained_earnings": ["Retained Earnings"],
    "minority_interest": ["Minority Interest"],
    "cash": ["Cash And Cash Equivalents"],
    "short_term_investments": ["Other Short Term Investments"],
    "restricted_cash": ["Restricted Cash"],
    "cash_and_st_investments": ["Cash Cash Equivalents And Short Term Investments"],
    "total_assets": ["Total Assets"],
    "stockholders_equity": ["Common Stock Equity", "Stockholders Equity", "Total Equity Gross Minority Interest"],
    "goodwill": ["Goodwill"],
    "ppe_net": ["Net PPE"],
    "inventory": ["Inventory"],
    "receivables": ["Receivables", "Accounts Receivable"],
    "intangibles": ["Other Intangible Assets"],
    "long_term_investments": ["Investments And Advances", "Long Term Investments",
                              "Investmentin Financial Assets", "Long Term Equity Investment"],
    "long_term_debt": ["Long Term Debt"],
    "short_term_debt": ["Current Debt", "Current Debt And Capital Lease Obligation"],
    "debt_total_legacy": ["Total Debt"],
    "total_liabilities": ["Total Liabilities Net Minority Interest"],
    "accounts_payable": ["Accounts Payable", "Payables"],
    "accrued_liabilities": ["Current Accrued Expenses"],
    "deferred_revenue": ["Current Deferred Revenue"],
    "lease_liabilities": ["Long Term Capital Lease Obligation", "Capital Lease Obligations"],
    "operating_cf": ["Operating Cash Flow", "Cash Flow From Continuing Operating Activities"],
    "capex": ["Capital Expenditure", "Purchase Of PPE"],
    "cash_dividends_paid": ["Cash Dividends Paid", "Common Stock Dividend Paid", "Dividends Paid Direct"],
}
# Fields of the first A-share source.
ASHARE_FIELDS = {
    "income": {
        "revenue": ["total_revenue", "revenue"], "cost_of_revenue": ["oper_cost"],
        "operating_income": ["operate_profit"], "net_income": ["n_income_attr_p", "n_income"],
        "diluted_eps": ["diluted_eps", "basic_eps"], "rd_expense": ["rd_exp"], "pretax_income": ["total_profit"],
        "income_tax": ["income_tax"], "ebitda": ["ebitda"], "interest_expense": ["fin_exp_int_exp"],
        "selling_marketing_expense": ["sell_exp"], "general_admin_expense": ["admin_exp"]},
    "balance": {
        "cash": ["money_cap"], "short_term_investments": ["trad_asset"], "total_assets": ["total_assets"],
        "stockholders_equity": ["total_hldr_eqy_exc_min_int"], "goodwill": ["goodwill"],
        "ppe_net": ["fix_assets", "fix_assets_total"], "inventory": ["inventories"],
        "receivables": ["accounts_receiv"], "intangibles": ["intan_assets"],
        "long_term_investments": ["lt_eqt_invest"], "total_liabilities": ["total_liab"],
        "long_term_debt": ["lt_borr"], "short_term_debt": ["st_borr"],
        "accounts_payable": ["acct_payable", "accounts_pay"], "deferred_revenue": ["contract_liab", "adv_receipts"],
        "current_assets": ["total_cur_assets"], "current_liabilities": ["total_cur_liab"],
        "retained_earnings": ["undistr_porfit"], "minority_interest": ["minority_int"],
        "diluted_shares": ["total_share"]},
    "cashflow": {"operating_cf": ["n_cashflow_act"], "capex": ["c_pay_acq_const_fiolta"]},
}
# Fields of the second A-share source.
SECOND_FIELDS = {
    "income": {"revenue": ["TOTAL_OPERATE_INCOME"], "cost_of_revenue": ["OPERATE_COST"],
               "operating_income": ["OPERATE_PROFIT"], "net_income": ["PARENT_NETPROFIT"],
               "diluted_eps": ["DILUTED_EPS", "BASIC_EPS"]},
    "balance": {"total_assets": ["TOTAL_ASSETS"], "total_liabilities": ["TOTAL_LIABILITIES"],
                "stockholders_equity": ["TOTAL_PARENT_EQUITY"], "cash": ["MONETARYFUNDS"],
                "inventory": ["INVENTORY"]},
    "cashflow": {"operating_cf": ["NETCASH_OPERATE"], "capex": ["CONSTRUCT_LONG_ASSET"]},
}
# Metrics a source states as outflow-positive, stored negative.
NEGATED = ["capex"]
# Standard fields of a results release that are named differently.
RELEASE_RENAMES = {"diluted_eps_per_ads": "diluted_eps", "diluted_ads": "diluted_shares"}
RELEASE_FIELDS = ["revenue", "cost_of_revenue", "gross_profit", "operating_income", "net_income",
                  "diluted_eps_per_ads", "diluted_ads", "cash", "total_assets", "total_liabilities",
                  "stockholders_equity", "short_term_debt", "long_term_debt", "accounts_payable",
                  "deferred_revenue", "operating_cf", "capex", "short_term_investments", "restricted_cash",
                  "receivables", "inventory", "ppe_net", "goodwill", "intangibles", "long_term_investments"]
RELEASE_CASH_FLOW = ["operating_cf", "capex"]

# Display label of each metric in blended statements.
METRIC_LABELS = {
    "revenue": "Total Revenue", "gross_profit": "Gross Profit", "cost_of_revenue": "Cost Of Revenue",
    "operating_income": "Operating Income", "net_income": "Net Income", "diluted_eps": "Diluted EPS",
    "diluted_shares": "Diluted Average Shares", "rd_expense": "Research And Development",
    "sga_expense": "Selling General And Administration",
    "selling_marketing_expense": "Selling And Marketing Expense",
    "general_admin_expense": "General And Administrative Expense", "pretax_income": "Pretax Income",
    "income_tax": "Tax Provision", "interest_expense": "Interest Expense", "ebitda": "EBITDA",
    "operating_cf": "Cash Flow From Continuing Operating Activities", "capex": "Capital Expenditure",
    "cash_dividends_paid": "Cash Dividends Paid", "cash": "Cash And Cash Equivalents",
    "short_term_investments": "Short Term Investments", "restricted_cash": "Restricted Cash",
    "cash_and_st_investments": "Cash Cash Equivalents And Short Term Investments",
    "total_assets": "Total Assets", "stockholders_equity": "Common Stock Equity", "goodwill": "Goodwill",
    "ppe_net": "Net PPE", "inventory": "Inventory", "receivables": "Receivables",
    "intangibles": "Other Intangible Assets", "long_term_investments": "Long Term Investments",
    "total_liabilities": "Total Liabilities", "long_term_debt": "Long Term Debt",
    "short_term_debt": "Current Debt", "accounts_payable": "Accounts Payable",
    "accrued_liabilities": "Accrued Liabilities", "deferred_revenue": "Deferred Revenue",
    "lease_liabilities": "Lease Obligations", "current_assets": "Current Assets",
    "current_liabilities": "Current Liabilities", "retained_earnings": "Retained Earnings",
    "minority_interest": "Minority Interest",
}

# Names usable in user metrics and their kind.
ALIAS_KINDS = {
    "revenue": "flow", "cogs": "flow", "gross_profit": "flow", "op_income": "flow", "net_income": "flow",
    "eps": "per_share", "sga": "flow", "s_and_m": "flow", "g_and_a": "flow", "ocf": "flow", "capex": "flow",
    "fcf": "flow", "shares": "stock", "cash": "stock", "sti": "stock", "restricted_cash": "stock",
    "cash_all": "stock", "receivables": "stock", "inventory": "stock", "ppe": "stock", "goodwill": "stock",
    "intangibles": "stock", "lt_investments": "stock", "total_assets": "stock", "total_liabilities": "stock",
    "equity": "stock", "total_debt": "stock", "current_debt": "stock", "lt_debt": "stock", "leases": "stock",
    "ap": "stock", "accrued": "stock", "deferred_revenue": "stock", "price": "market", "mcap": "market",
}


# Statement metric behind each alias; fcf and total_debt are derived, price and mcap come from the market.
ALIAS_METRICS = {
    "revenue": "revenue", "cogs": "cost_of_revenue", "gross_profit": "gross_profit", "op_income": "operating_income",
    "net_income": "net_income", "eps": "diluted_eps", "sga": "sga_expense", "s_and_m": "selling_marketing_expense",
    "g_and_a": "general_admin_expense", "ocf": "operating_cf", "capex": "capex", "shares": "diluted_shares",
    "cash": "cash", "sti": "short_term_investments", "restricted_cash": "restricted_cash",
    "cash_all": "cash_and_st_investments", "receivables": "receivables", "inventory": "inventory", "ppe": "ppe_net",
    "goodwill": "goodwill", "intangibles": "intangibles", "lt_investments": "long_term_investments",
    "total_assets": "total_assets", "total_liabilities": "total_liabilities", "equity": "stockholders_equity",
    "current_debt": "short_term_debt", "lt_debt": "long_term_debt", "leases": "lease_liabilities",
    "ap": "accounts_payable", "accrued": "accrued_liabilities", "deferred_revenue": "deferred_revenue",
}


def concept_dimension(spark: SparkSession) -> DataFrame:
    """KPI-16: (metric, concept, rank, kind, grp) rows; grp is 0 for plain priorities and for
    composite totals, 1.. for component groups."""
    rows = []
    for kind, tab in (("flow", INCOME_CONCEPTS), ("shares", SHARE_CONCEPTS), ("per_share", EPS_CONCEPTS),
                      ("cash_flow", CASH_FLOW_CONCEPTS), ("stock", BALANCE_CONCEPTS)):
        rows += [(m, c, i, kind, 0, False) for m, cs in tab.items() for i, c in enumerate(cs)]
    for m, spec in COMPOSITES.items():
        rows += [(m, c, i, "stock", 0, True) for i, c in enumerate(spec["total"])]
        rows += [(m, c, i, "stock", g, True) for g, cs in enumerate(spec["parts"], 1) for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "metric string, concept string, rank int, kind string, grp int, composite boolean")


def label_dimension(spark: SparkSession, table: dict[str, list[str]]) -> DataFrame:
    """FLT-23: (metric, label, rank, sign) rows of one label table."""
    rows = [(m, lab, i, -1.0 if m in NEGATED else 1.0) for m, labs in table.items() for i, lab in enumerate(labs)]
    return spark.createDataFrame(rows, "metric string, label string, rank int, sign double")
