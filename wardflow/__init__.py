"""wardflow: waiting-list analytics as Spark DataFrame operators.

Entry points (each takes and returns DataFrames):

- ``wardflow.sources.patients.patient_table(spark, data_dir)``: the patient table;
- ``wardflow.operators``: ``filters``, ``groups``, ``queue``, ``inspect``,
  ``model``, ``questions``;
- ``wardflow.plans.answers.answer_questions(questions, patients)``: a whole
  question log answered in one job;
- ``wardflow.plans.full_run.run_full(spark, data_dir)``: score, persist and
  list high-risk patients;
- ``wardflow.streaming.questions``: the same over a stream of question files.
"""

__version__ = "0.1.0"
