"""Reading sheets and document folders; keyed table maintenance."""
