"""sheetwise: Spark DataFrame operators for tables of detections on digitised paper forms."""
