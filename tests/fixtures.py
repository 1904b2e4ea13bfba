"""Hand-made test inputs (FIXTURES.md sections 3 and 5)."""

from __future__ import annotations

# FIXED VALUES: the first eight are the application's sample questions; the rest probe
# its parsing rules. Expected intent and route per question.
QUESTIONS = [
    (1, "What is the average wait time for Cardiology and Orthopedics?", "average_wait_time", "average_wait_time"),
    (2, "Show me high risk patients with readmission risk above 70%", "high_risk_patients", "high_risk_by_specialty"),
    (3, "Reduce cancellations by 15%", "cancellation_reduction", "cancellation_reduction"),
    (4, "What is the cost impact for Orthopedics?", "cost_impact", "cost_impact"),
    (5, "What is the cost impact by specialty?", "cost_impact", "cost_impact"),
    (6, "Show seasonal analysis for Winter", "seasonal_analysis", "seasonal_analysis"),
    (7, "What is the average cost for young adults?", "age_based_cost", "age_based_cost"),
    (8, "Impact of Baseline capacity 200 and Capacity Increase by 20%", "capacity_analysis", "capacity_kpis"),
    (9, "average cost of hernia surgery", "age_based_cost", "age_based_cost"),
    (10, "boost throughput by 10", "capacity_analysis", "preview_rows"),
    (11, "increase the cancellation rate by 5", "capacity_analysis", "cancellation_reduction"),
    (12, "Which season has the highest cost?", "seasonal_cost", "preview_rows"),
    (13, "readmission in winter", "general_analysis", "preview_rows"),
    (14, "young adult readmission risk", "age_based_risk", "age_based_risk"),
    (15, "ENT specialty breakdown", "specialty_analysis", "specialty_analysis"),
    (16, "which season is worst for waiting", "seasonal_comparison", "preview_rows"),
    (17, "age 45 risk", "age_based_risk", "age_based_risk"),
    (18, "risk between 30 and 50 by age", "age_based_risk", "age_based_risk"),
    (19, "cancellations by age group", "general_analysis", "preview_rows"),
]
