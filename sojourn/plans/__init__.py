"""Query registry (Spark side), the matching DuckDB oracle SQL, and the two
end-to-end pipelines (trace summary, bound report)."""
