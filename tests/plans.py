def plan_text(df) -> str:
    """Executed plan as text, after adaptive execution when it has run."""
    return df._jdf.queryExecution().executedPlan().toString()
