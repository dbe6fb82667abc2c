import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TESTDATA = Path("/root/testdata")
SMALL = str(TESTDATA / "sf0.001")


@pytest.fixture(scope="session")
def spark():
    from loanscope.session import local_session

    s = local_session(cores=4, shuffle_partitions=8, app="loanscope-tests")
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loanscope-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def small_loans(spark):
    from loanscope.sources.store import loans

    return loans(spark, SMALL)


# Types of the loan table columns (sources.store.LOAN_COLUMNS).
_STRING = {
    "term", "grade", "sub_grade", "loan_status", "purpose", "home_ownership", "addr_state",
    "issue_d", "last_pymnt_d", "earliest_cr_line", "zip_code", "debt_settlement_flag",
    "pymnt_plan", "payment_timing", "hardship_flag", "disbursement_method", "initial_list_status",
    "application_type", "emp_title",
}


def loan_schema():
    from pyspark.sql import types as T

    from loanscope.sources.store import LOAN_COLUMNS

    return T.StructType([
        T.StructField(c, T.StringType() if c in _STRING else T.LongType(), True) for c in LOAN_COLUMNS
    ])


_DEFAULTS = dict(
    loan_amnt=10000, funded_amnt=10000, funded_amnt_inv=10000, term="36 months", int_rate_bp=1000,
    grade="B", sub_grade="B1", loan_status="Fully Paid", purpose="car", home_ownership="RENT",
    addr_state="NY", annual_inc=50000, dti_bp=1000, issue_d="Jan-2010", last_pymnt_d="Jan-2013",
    earliest_cr_line="Jan-2000", installment_c=30000, total_pymnt=11000, total_rec_prncp=10000,
    total_rec_int=1000, total_rec_late_fee=0, recoveries=0, collection_recovery_fee=0,
    zip_code="100xx", delinq_2yrs=0, pub_rec=0, mths_since_last_delinq=None, inq_last_6mths=0,
    debt_settlement_flag="N", total_acc=10, pymnt_plan="n", tax_liens=0, policy_code=1, acc_now_delinq=0,
    hardship_flag="N", delinq_amnt=0, disbursement_method="Cash", initial_list_status="f",
    collections_12_mths_ex_med=0, out_prncp=0, out_prncp_inv=0, application_type="Individual",
    emp_title="clerk", issue_year=2010,
    credit_opened_year=2000, term_months=36, months_made_payment=36, payment_timing="early",
)


def make_loans(spark, rows):
    """Small hand-made loan table: each row a dict overriding defaults."""
    from loanscope.sources.store import LOAN_COLUMNS

    data = []
    for i, r in enumerate(rows, start=1):
        d = dict(_DEFAULTS, loan_id=i)
        d.update(r)
        data.append(tuple(d[c] for c in LOAN_COLUMNS))
    return spark.createDataFrame(data, loan_schema())
