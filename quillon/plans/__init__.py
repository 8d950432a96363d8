"""Walk-forward plans and reports."""
