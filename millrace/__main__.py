from millrace.jobs import main

main()
